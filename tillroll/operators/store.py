"""Trained classifiers kept in a folder, and read again in another session.

A model is four files' worth: its words and its nodes as tables bucketed by the columns that texts are joined on, a
manifest, and nothing that depends on the session. Texts meet a kept model bucket by bucket: the model's side of
that join is neither shuffled nor sorted again, however often it is used.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tillroll.functions.text import words
from tillroll.operators.bayes import Cut, Model
from tillroll.operators.features import words_and_char_ngrams, words_and_ngrams

VERSION = 1
# Ways to make features of a text, by the name a manifest keeps.
CUTS: dict[str, Cut] = {c.__name__: c for c in (words, words_and_ngrams, words_and_char_ngrams)}


def _bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> str:
    """Write `df` to `path` in buckets; the schema as text. The table's name lives in this session only."""
    name = f"kept_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _opened(spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int) -> DataFrame:
    name, on = f"kept_{uuid.uuid4().hex}", ", ".join(keys)
    location = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({on}) SORTED BY ({on}) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)


def save_model(model: Model, path: str, buckets: int = 64) -> None:
    """Keep a naive Bayes model under `path`, which must not exist yet. `buckets` should let a bucket of words fit
    a task. The way texts are cut has to be one of `CUTS`, so that another session can find it by name."""
    name = next((n for n, c in CUTS.items() if c is model.cut), None)
    if name is None:
        raise ValueError("features of this model have no name; add them to CUTS")
    spark = model.tokens.sparkSession
    keys = [*model.by, "parent", "token"]
    manifest = {
        "version": VERSION,
        "by": list(model.by),
        "cut": name,
        "buckets": buckets,
        "tokens": _bucketed(model.tokens, f"{path}/tokens", keys, buckets),
        "nodes": _bucketed(model.nodes, f"{path}/nodes", keys[:-1], 1),
    }
    # the manifest comes last: a folder without one is not a whole model
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load_model(spark: SparkSession, path: str) -> Model:
    """The model that `save_model` kept under `path`."""
    lines = spark.read.text(f"{path}/manifest").collect()
    manifest = json.loads(lines[0]["value"]) if lines else {}
    if manifest.get("version") != VERSION:
        raise ValueError(f"no model of version {VERSION} in {path}")
    by = manifest["by"]
    keys = [*by, "parent", "token"]
    return Model(
        _opened(spark, f"{path}/nodes", manifest["nodes"], keys[:-1], 1),
        _opened(spark, f"{path}/tokens", manifest["tokens"], keys, manifest["buckets"]),
        tuple(by),
        CUTS[manifest["cut"]],
    )
