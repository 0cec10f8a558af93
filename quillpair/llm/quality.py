"""Text quality statistics, and telling prose from lists, tables and junk.

Statistics are taken of every line and of every document: words, their mean length,
shares of symbols, digits and common words, list marks, separators of columns, and
whether lines end as sentences do.  A Gaussian mixture is fitted by
expectation-maximization to the standardized statistics of lines; its components begin
at groups of inspected examples and then move freely.  After the fit the examples tell
which component is prose, list, table or junk, and a document's characters are shared
out over these line by line.

A line of few words says little by itself -- hand-wrapped prose ends in such lines,
lists are made of them -- so the lines around it, up to a blank line, are statistics
of a line as well.

The mixture is fitted to the lines of all documents.  Their statistics are written once;
a round is one aggregation of weights, sums and outer products over them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillpair.sources.shared import stage_table

#: Most rounds of the fit.
ROUNDS = 40
KINDS = ("prose", "list", "table", "junk")

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_DIGITS = re.compile(r"\d")
_MARK = re.compile(r"\s*(?:[-*+•‣◦–—·▪●○]|\[[ xX✓]?\]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])(?:\s|$)")
_QUOTE = re.compile(r"(?:\s*>)+\s?")
_COLUMNS = re.compile(r"\||\t|\S {2,}(?=\S)|[,;=](?=\S)")
_ENDS = (".", "!", "?", "…", ":", "。", "！", "？", '."', '?"', '!"', ".”", "?”", "!”", ".)", "?)", "!)", ".'", "?'", "!'")

#: Inspected examples, written for this purpose: runs of lines as posts have them, by what they are and how.
EXAMPLES: dict[tuple[str, str], list[str]] = {
    ("prose", "sentences"): [
        "The repair took three weeks, which was longer than we had been told, and the bill came to 240 dollars in the end.",
        "It depends on the roof: if it is flat, then seal it first, or else leave it until spring. Most of the advice I found about gutters was written by people who had not cleaned one in years.",
        "Wir haben die Heizung nicht selbst eingebaut, weil uns dafür das Werkzeug fehlte. Nach zwei Tagen war sie wieder kalt, und der Händler hat sie ohne ein Wort ersetzt.",
        "Je ne sais pas si le train de midi circule encore, mais il faut réserver une place avant de partir. Nous sommes restés une semaine au bord du lac.",
        "El puente estaba cerrado por las obras, así que tuvimos que dar la vuelta por el pueblo. No es una buena idea salir sin agua en verano.",
    ],
    ("prose", "short question"): [
        "How long does fresh pasta keep in the fridge?",
        "Why do bicycle brakes squeal after rain?",
        "Can I grow lemons indoors during winter in Norway?",
    ],
    ("prose", "without marks"): [
        "i think that most people who ask this have never tried it for more than a week and then they say it did not work at all",
        "wenn man die tür im winter offen lässt, wird es in dem ganzen haus kalt\nund die heizung läuft dann auch in der nacht weiter, was nicht billig ist",
        "on peut prendre le bus ou y aller à pied mais il faut partir tôt parce que la route est longue et il fait chaud",
        "lo mejor es dejar la masa en un lugar seco durante la noche\ny no abrir el horno hasta que el pan esté bien hecho",
    ],
    ("prose", "hand-wrapped"): [
        "The ferry leaves at seven in the morning and does not\nwait for anybody, so most of the guests stay in the\nharbour for the night.",
        "behind the school. He asked if the old key would still\nfit, and they told him that nobody had changed the\nlock.",
        "after the storm. If you need to dry a tent, hang it in\nthe shade and turn it once an hour until the seams are\ndry.",
        "den Schlüssel. Es war schon dunkel, als wir an der\nHütte ankamen, und keiner von uns hatte eine Lampe. So\nblieb es kalt.",
    ],
    ("list", "marked"): [
        "- olive oil\n- two onions, chopped\n- smoked paprika",
        "* window cleaner;\n* spare bulbs;\n• batteries AA!\n• tape measure?",
        "+ Schrauben M6\n+ Dübel, Winkel\n[ ] call electrician\n[x] order tiles!",
    ],
    ("list", "numbered"): [
        "1. preheat oven\n2. grease tin\n3. sift flour, sugar",
        "12) Lisbon harbour\n13) Porto cathedral\n(4) Coimbra library",
        "a) passport\nb) vaccination card\nc) travel insurance\nd) billete de tren",
    ],
    ("list", "names"): [
        "Oakland Museum\nGolden Gate Park\nPier Thirty-Nine",
        "Rathaus Altona\nBahnhof Dammtor\nFischmarkt\nPlaza Mayor",
    ],
    ("list", "entries"): [
        "brakes worn: replaced\nheadlight: cracked\nchain: stretched, oiled",
        "tamaño cocina: mediano\nmaterial: acero",
    ],
    ("table", "bars"): [
        "| city | rain mm | days |\n| --- | --- | --- |\n| Bergen | 2495.0 | 231 |",
        "Granite |    2691    |    6.5\n   2.75   |   170   |  Marble",
    ],
    ("table", "tabs"): ["0.125\t3020\tsteel\nzinc\t419.5\t7.14", "year\tharvest\tprice\n1998\t3.41\t12\tgood"],
    ("table", "commas"): ["1998,Bordeaux,13.5,8200\nRioja,14,6100", "date,open,high,low\n04-02,101.5,103.2,99.8"],
    ("table", "spaces"): ["Helium       4.0026        2\n0.1785        -268.9        gas", "planet        mass        moons\nMars        0.107        2"],
    ("table", "fields"): ["width=120.5; height=80; depth=33.25", "user=anna; visits=42; country=Chile; plan=basic"],
    ("junk", "symbols"): ["%%^&* ##@! ~~~ ||| ^^%$ <<>> {}{} ==+= *&^% $#@!", "= = = = = = = = = = = = = = = = = = = = = =", "/\\/\\/\\/\\ ____ ---- **** ++++ |||| ~~~~"],
    ("junk", "keys struck"): [
        "wqkjehr lkajsd;fo qwpoeir zmxncb asldkfj; qpwoeiru alskdjf",
        "dfghdf jkl;jkl tyutyui vbnmvbn sdfgsdfg rtyurtyu;hjkl",
    ],
    ("junk", "repeated letters"): ["loooooooooooooooooooooooooooooooooooooool", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "hehehehehehehehehehehehehehehehehehehehe"],
    ("junk", "encoded"): ["iVBORw0KGgoAAAANSUhEUgAAAAUAAAAFCAYAAACNbyblAAAAHElEQVQI12P4\n//8/w38GIAXDIBKE0DHxgljNBAAO9TXL0Y4OHwAAAABJRU5ErkJggg"],
    ("junk", "log"): ["[12:04:55] ERROR pid=881 errno=0x1f\n[12:04:56] INFO pid=881 retry=0x20", "2019-11-30 23:59:58 WARN thread=4 status=503 addr=0xffe1"],
    ("junk", "menu"): ["Home | About | Contact | Login | Register | Help | Sitemap |", "Back | Share | Print | Next | Top | Archive"],
    ("junk", "shouted offers"): [
        "cheap watches!!! cheap watches $$$ cheap watches >>> buy cheap watches!!!",
        "CLICK HERE >>> CLICK HERE!!! CLICK HERE CLICK HERE $$$ CLICK HERE >>>",
        "free prizes free prizes $$$ free prizes free prizes!!! free prizes >>> free prizes",
    ],
    ("junk", "joined small words"): [
        "of when at this from one if who were be into on they for so an all we out the but more you are by to",
        "les un dans qui pour par que sur est une ne pas au vous mais ou plus des elle son avec ce",
        "und mit der als ein auf nicht wenn noch bei so wie es wird aber nur sie aus dem zu",
        "que las con una del por para sus más pero como ya muy sin sobre este hay nos le al",
    ],
    ("junk", "joined names"): [
        "antrovex belimundo cartogril dorpavesk elunimar fostribek gravolint hesperudo",
        "jorvenal kelstrigo lumefarid montivesk noruphel ostrigal pelvorand quastimir",
    ],
    ("junk", "code"): ["while (i < n) {\n\ttotal += price[i++];\n}", "def area(r):\n\treturn 3.14 * r ** 2\nprint(area(2))"],
}


def line_statistics(text: str, common: frozenset[str] | set[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(statistics, characters without blanks)`` of the text's lines that are not blank."""
    rows, sizes, runs = [], [], []
    run = 0
    for line in text.splitlines():
        if not line.strip():
            run += 1
            continue
        quoted = _QUOTE.match(line)
        body = line[quoted.end() :] if quoted else line
        parts = body.split()
        size = sum(map(len, line.split()))
        solid = max(1, sum(map(len, parts)))
        words = _WORD.findall(body)
        letters = sum(map(len, words))
        digits = len(_DIGITS.findall(body))
        mark = _MARK.match(body)
        low = [w.lower() for w in words]
        known = sum(w in common for w in (low[1:] if mark and low and len(low[0]) == 1 else low))
        again = max(Counter(low).values()) - 1 if len(low) > 2 else 0
        rows.append(
            (
                known / max(1, len(words)),
                math.log1p(len(words)),
                math.log1p(letters / max(1, len(words))),
                max(0, solid - letters - digits) / solid,
                digits / solid,
                float(body.rstrip().endswith(_ENDS)),
                float(mark is not None),
                math.log1p(len(_COLUMNS.findall(body.strip())) / max(1, len(parts)) * 4),
                math.log1p(solid / max(1, len(parts))),
                known,
                len(words),
                float(body[:1].islower() or body[:1] in "\"'“"),
                again / max(1, len(words)),
            )
        )
        sizes.append(size)
        runs.append(run)
    if not rows:
        return np.empty((0, WIDTH)), np.empty(0, np.int64)
    x, run = np.array(rows), np.array(runs)
    known, words = x[:, 9], x[:, 10]
    # the same shares over the lines around, up to two on each side within a run, without those with a mark
    near_known, near_words = known.copy(), words.copy()
    for step in (1, 2):
        same = (run[step:] == run[:-step]) & (x[step:, 6] == x[:-step, 6])
        close = same & (np.abs(x[step:, 3] - x[:-step, 3]) < 0.25)
        near_known[step:] += np.where(close, known[:-step], 0)
        near_words[step:] += np.where(close, words[:-step], 0)
        near_known[:-step] += np.where(close, known[step:], 0)
        near_words[:-step] += np.where(close, words[step:], 0)
    around = near_known / np.maximum(1, near_words)
    return np.column_stack([x[:, :9], around, x[:, 11:]]), np.array(sizes)


WIDTH = 12
NAMES = ("common", "words", "word_length", "symbols", "digits", "ends", "mark", "columns", "token_length", "common_around", "starts_low", "repeated")


class Mixture:
    """Gaussian mixture with full covariances."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, centre: np.ndarray, spread: np.ndarray):
        self.mean, self.scale, self.weight, self.centre, self.spread = mean, scale, weight, centre, spread
        self._prepare()

    def _prepare(self) -> None:
        self.root = np.linalg.inv(np.linalg.cholesky(self.spread))
        self.constant = np.log(self.weight) + np.log(np.diagonal(self.root, axis1=1, axis2=2)).sum(1)

    def _log(self, z: np.ndarray) -> np.ndarray:
        out = np.empty((len(z), len(self.weight)))
        for k in range(len(self.weight)):
            d = (z - self.centre[k]) @ self.root[k].T
            out[:, k] = self.constant[k] - 0.5 * np.einsum("ij,ij->i", d, d)
        return out

    def best(self, x: np.ndarray) -> np.ndarray:
        """The component that most likely made each row."""
        return self._log((x - self.mean) / self.scale).argmax(1)

    def held(self, x: np.ndarray) -> np.ndarray:
        """Sums over rows: for each component its share of the rows, of them and of products of two statistics; and the log-likelihood."""
        n, width = self.centre.shape
        i, j = np.triu_indices(width)
        total = np.zeros((n, 1 + width + len(i)))
        likely = 0.0
        precision = np.transpose(self.root, (0, 2, 1)) @ self.root
        turned = np.einsum("kij,kj->ki", precision, self.centre)
        flat = np.concatenate([(self.constant - 0.5 * (turned * self.centre).sum(1))[:, None], turned, np.where(i == j, -0.5, -1.0) * precision[:, i, j]], axis=1)
        for k in range(0, len(x), 8_192):
            z = np.ascontiguousarray(((x[k : k + 8_192] - self.mean) / self.scale).T)
            powers = np.concatenate([np.ones((1, z.shape[1])), z, z[i] * z[j]])
            log = flat @ powers
            top = log.max(0)
            part = np.exp(log - top)
            whole = part.sum(0)
            likely += float((top + np.log(whole)).sum())
            total += (part / whole) @ powers.T
        return np.append(total.ravel(), likely)

    @classmethod
    def fit(cls, gather: Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray], starts: list[np.ndarray], rounds: int = ROUNDS, floor: float = 0.05, gain: float = 0.01) -> Mixture:
        """Expectation-maximization over all rows, with a component for each group of lines in ``starts``.

        ``gather`` adds up what a function gives for parts of the rows.  The groups say where
        the components begin, and take part in the standardization, so that a handful of rows
        is standardized too; nothing holds a component to its group afterwards.  A component
        that less than one row falls to stays where it is.  Variances stay above ``floor`` of
        the standardized statistics'.  It ends when a round raises the log-likelihood of a row
        by less than ``gain``.
        """
        own = np.concatenate(starts)
        width = own.shape[1]
        first = gather(_sums) + _sums(own)
        n = first[0] - len(own)
        mean = first[1:] / first[0]
        spread = gather(lambda x: ((x - mean) ** 2).sum(0)) + ((own - mean) ** 2).sum(0)
        scale = np.maximum(np.sqrt(spread / first[0]), 1e-6)
        groups = [(a - mean) / scale for a in starts]
        k, eye = len(groups), np.eye(width)
        upper, lower = np.triu_indices(width)
        centre = np.stack([g.mean(0) for g in groups])
        around = np.stack([(g - c).T @ (g - c) / len(g) for g, c in zip(groups, centre, strict=True)])
        model = cls(mean, scale, np.full(k, 1 / k), centre, around + 2 * floor * eye)
        before = -np.inf
        for _ in range(rounds if n else 0):
            found = gather(model.held)
            now = float(found[-1] / n)
            found = found[:-1].reshape(k, -1)
            part, total, square = found[:, 0], found[:, 1 : 1 + width], np.empty((k, width, width))
            square[:, upper, lower] = square[:, lower, upper] = found[:, 1 + width :]
            model.weight = np.maximum(part, 1e-6) / np.maximum(part, 1e-6).sum()
            for j in np.flatnonzero(part >= 1):
                c = model.centre[j] = total[j] / part[j]
                around = square[j] / part[j] - np.outer(c, c)
                model.spread[j] = (around + around.T) / 2 + floor * eye
            model._prepare()
            if abs(now - before) < gain:
                break
            before = now
        return model

    def kinds(self, groups: list[np.ndarray], kind: np.ndarray) -> np.ndarray:
        """What each component is, told after the fit by inspected lines.

        Each group of lines has one vote for its kind, split over the components that likely
        made its lines; a component without a vote is what the line likeliest in it is.
        """
        likely = [self._log((g - self.mean) / self.scale) for g in groups]
        votes = np.zeros((len(self.weight), len(KINDS)))
        for log, of in zip(likely, kind, strict=True):
            part = np.exp(log - log.max(1, keepdims=True))
            votes[:, of] += (part / part.sum(1, keepdims=True)).mean(0)
        nearest = kind[np.stack([log.max(0) for log in likely]).argmax(0)]
        return np.where(votes.sum(1) < 1e-3, nearest, votes.argmax(1))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.append(len(x), x.sum(0))


def _inspected(common: frozenset[str] | set[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Statistics of the inspected lines by group, and each group's kind."""
    lines = [np.concatenate([line_statistics(t, common)[0] for t in texts]) for texts in EXAMPLES.values()]
    return lines, np.array([KINDS.index(kind) for kind, _ in EXAMPLES])


def _lines(documents: DataFrame, key: str, text: str, common: frozenset[str]) -> DataFrame:
    """``key, x, size``: statistics of all lines of each document, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_statistics(t or "", common) for t in batch.column(1).to_pylist()]
            parts = [pa.array([np.ascontiguousarray(part, kind).tobytes() for part in column], pa.binary()) for column, kind in zip(list(zip(*found, strict=True)) or [(), ()], (np.float64, np.int64), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], [key, "x", "size"])

    rows = documents.select(key, text)
    return stage_table(rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, x binary, size binary"), "lines")


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def fit_mixture(lines: DataFrame, common: frozenset[str]) -> tuple[Mixture, np.ndarray]:
    """The mixture of all lines and its components' kinds."""
    x = lines.select("x")

    def gather(f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                total = total + f(_numbers(batch.column(0), np.float64).reshape(-1, WIDTH))
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        parts = x.mapInArrow(run, "total binary").rdd.map(lambda r: np.frombuffer(r[0], np.float64))
        return parts.treeAggregate(f(np.empty((0, WIDTH))), lambda a, b: a + b, lambda a, b: a + b)

    groups, kind = _inspected(common)
    mixture = Mixture.fit(gather, groups)
    return mixture, mixture.kinds(groups, kind)


def document_statistics(documents: DataFrame, key: str, text: str, common: set[str]) -> DataFrame:
    """Per document: characters without blanks, words, mean word length, shares of symbols, common words and of
    lines ending as sentences, and the share of its characters in prose, lists, tables and junk.

    Null, empty and blank texts have 0 characters and words and null shares.  Repeated
    rows and null keys are kept.
    """
    rows = _lines(documents, key, text, frozenset(common))
    shared = documents.sparkSession.sparkContext.broadcast(fit_mixture(rows, frozenset(common)))
    names = ["characters", "words", "mean_word_length", "symbol_ratio", "common_ratio", "ended_ratio", *KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture, kinds_of = shared.value
        for batch in batches:
            count = np.array([len(s) // 8 for s in batch.column(2).to_pylist()], np.int64)
            x = _numbers(batch.column(1), np.float64).reshape(-1, WIDTH)
            size = _numbers(batch.column(2), np.int64)
            owner = np.repeat(np.arange(len(count)), count)
            words = np.rint(np.expm1(x[:, 1]))
            total = lambda v: np.bincount(owner, v, len(count))
            characters, all_words, lines = total(size), total(words), np.maximum(count, 1)
            chars, some = np.maximum(characters, 1), np.maximum(all_words, 1)
            kind = np.zeros((len(x), len(KINDS)))
            if len(x):
                kind[np.arange(len(x)), kinds_of[mixture.best(x)]] = size
            ratios = [total(np.expm1(x[:, 2]) * words) / some, total(x[:, 3] * size) / chars, total(x[:, 0] * words) / some, total(x[:, 5]) / lines]
            ratios += [total(kind[:, k]) / chars for k in range(len(KINDS))]
            blank = characters == 0
            columns = [pa.array(characters.astype(np.int64)), pa.array(all_words.astype(np.int64)), *(pa.array(np.round(r, 6), mask=blank) for r in ratios)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *names])

    kinds = ", ".join(f"{n} {'long' if n in ('characters', 'words') else 'double'}" for n in names)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, {kinds}")
