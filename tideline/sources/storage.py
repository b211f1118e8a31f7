"""Saved fits: Parquet by channel beside a JSON description, and fingerprints of what was fitted.

Tables are written to a staging folder by Spark and the description is written last,
so a folder with a description is whole.  Paths may be in any store Spark reaches.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans import model as plans

FORMAT, SCHEMA = "tideline-fit", 1
_TYPES = {c.__name__: c for c in vars(plans).values() if isinstance(c, type) and dataclasses.is_dataclass(c)}


def register_type(cls: type) -> type:
    """Lets a dataclass of one's own be saved and loaded; names must be new."""
    if not dataclasses.is_dataclass(cls):
        raise TypeError("only dataclasses can be registered")
    if _TYPES.get(cls.__name__, cls) is not cls:
        raise ValueError(f"the name {cls.__name__} is taken")
    _TYPES[cls.__name__] = cls
    return cls


def encode(x: object) -> object:
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        if _TYPES.get(type(x).__name__) is not type(x):
            raise TypeError(f"{type(x).__name__} isn't registered")
        return {"type": type(x).__name__, "fields": {f.name: encode(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    if isinstance(x, dict):
        return {"type": "dict", "fields": {k: encode(v) for k, v in x.items()}}
    if isinstance(x, (list, tuple)):
        return [encode(v) for v in x]
    if x is None or isinstance(x, (str, int, float, bool)):
        return x
    raise TypeError(f"can't save {type(x).__name__}")


def decode(x: object) -> object:
    if isinstance(x, list):
        return tuple(decode(v) for v in x)
    if not isinstance(x, dict):
        return x
    if set(x) != {"type", "fields"}:
        raise ValueError(f"unknown entries: {sorted(x)}")
    fields = {k: decode(v) for k, v in x["fields"].items()}
    if x["type"] == "dict":
        return fields
    if x["type"] not in _TYPES:
        raise ValueError(f"unknown type {x['type']!r}")
    cls = _TYPES[x["type"]]
    if unknown := set(fields) - {f.name for f in dataclasses.fields(cls)}:
        raise ValueError(f"{x['type']} has no fields {sorted(unknown)}")
    return cls(**fields)


def fingerprint(model: object, obs: DataFrame, steps_per_year: int) -> str:
    """SHA-256 of the model, the steps and the observations.  Rows are digested in the tasks and the
    digests summed, so any order and partitioning of the same rows gives the same value."""
    names = sorted(obs.columns)
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names)), 256)
    parts = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    got = obs.agg(F.count(F.lit(1)), *(F.sum(p) for p in parts)).first()
    text = json.dumps([encode(model), steps_per_year, names, [str(v) for v in got]], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(path: str, tables: dict[str, DataFrame], model: object, obs: DataFrame, steps_per_year: int, **meta: object) -> str:
    """Write draws and whatever else a fit has; returns the path.  An existing path is replaced at the end."""
    spark = obs.sparkSession
    stage = f"{path.rstrip('/')}.staging"
    target, fs = _hadoop(spark, path)
    fs.delete(_hadoop(spark, stage)[0], True)
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("channel") if "channel" in df.columns else w).parquet(f"{stage}/{name}")
    about = {"format": FORMAT, "schema": SCHEMA, "model": encode(model), "steps_per_year": steps_per_year, "tables": sorted(tables), "fingerprint": fingerprint(model, obs, steps_per_year), "meta": meta}
    obs.write.mode("overwrite").parquet(f"{stage}/observations")
    text = json.dumps(about, sort_keys=True)
    spark.createDataFrame([(text, hashlib.sha256(text.encode()).hexdigest())], "text string, sha256 string").coalesce(1).write.mode("overwrite").json(f"{stage}/about")
    fs.delete(target, True)
    if not fs.rename(_hadoop(spark, stage)[0], target):
        raise OSError(f"can't move the staged fit to {path}")
    return path


def load(spark: SparkSession, path: str) -> dict:
    """{model, tables, observations, steps_per_year, meta, fingerprint} after all checks."""
    row = spark.read.schema("text string, sha256 string").json(f"{path}/about").first()
    if row is None or hashlib.sha256(row["text"].encode()).hexdigest() != row["sha256"]:
        raise ValueError("the description is missing or damaged")
    about = json.loads(row["text"])
    if (about.get("format"), about.get("schema")) != (FORMAT, SCHEMA):
        raise ValueError("not a saved fit of this version")
    model, obs = decode(about["model"]), spark.read.parquet(f"{path}/observations")
    if fingerprint(model, obs, about["steps_per_year"]) != about["fingerprint"]:
        raise ValueError("model or observations don't fit the fingerprint")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in about["tables"]}
    return {"model": model, "tables": tables, "observations": obs, "steps_per_year": about["steps_per_year"], "meta": about["meta"], "fingerprint": about["fingerprint"]}
