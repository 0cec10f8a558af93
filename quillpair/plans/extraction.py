"""Feature tables of views and extractors, in one go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpair.functions.text import view
from quillpair.operators import features
from quillpair.sources.io import choose, read_matrix, write_matrix
from quillpair.sources.shared import drop_table

#: Extractors by name: pairs in a view, and the view's name as prefix.
EXTRACTORS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "grams": lambda pairs, prefix: features.gram_features(pairs, prefix, edits=False),
    "edits": features.gram_features,
    "fuzzy": features.fuzzy_features,
    "tags": features.tag_features,
}


def extract(pairs: DataFrame, folder: str, views: str, extractors: str) -> DataFrame:
    """Writes ``folder/{view}_{extractor}`` for each choice; ``(view, extractor, path)`` of the tables.

    ``views`` and ``extractors`` are comma-separated; unknown names raise.
    """
    names = choose(extractors, list(EXTRACTORS))
    done = []
    for v in (n.strip() for n in views.split(",") if n.strip()):
        change = view(v)
        changed = pairs.withColumns({q: change(F.col(q)) for q in ("question1", "question2")})
        for e in names:
            path = f"{folder}/{v}_{e}"
            write_matrix(EXTRACTORS[e](changed, v), path)
            done.append((v, e, path))
    return pairs.sparkSession.createDataFrame(done, "view string, extractor string, path string")


def extract_vectors(pairs: DataFrame, folder: str, views: str, names: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The same for features of word vectors: each view with each of ``tables`` (vec_id, vec) by name.

    ``names`` (word, vec_id) holds the words' vectors by number, in all tables.
    """
    from quillpair.operators.embed import block_vector_features, in_blocks

    done = []
    for v in (n.strip() for n in views.split(",") if n.strip()):
        change = view(v)
        changed = pairs.withColumns({q: change(F.col(q)) for q in ("question1", "question2")})
        blocks, known = in_blocks(changed, names)
        for name, vecs in tables.items():
            path = f"{folder}/{v}_{name}"
            write_matrix(block_vector_features(blocks, known, vecs, f"{v}_{name}"), path)
            done.append((v, name, path))
        drop_table(blocks)
        drop_table(known)
    return pairs.sparkSession.createDataFrame(done, "view string, extractor string, path string")


def joined(written: DataFrame, keys: list[str]) -> DataFrame:
    """The written tables side by side, by key."""
    from quillpair.operators.matrix import side_by_side

    spark = written.sparkSession
    paths = [r["path"] for r in written.orderBy("path").collect()]  # a row for each table
    return side_by_side([read_matrix(spark, p) for p in paths], keys)
