"""Models on disk: Parquet tables with a manifest, validated when read."""

from __future__ import annotations

import json
import os
import platform
import tempfile
from dataclasses import dataclass, field

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadData
from ..functions.numerics import Reduction, check_float_environment
from ..operators.model import Model

SCHEMAS = {
    "vocab": "token string, df long, cf long, idf double",
    "weights": "doc_id string, token string, cnt long, tf double, weight double",
    "stats": "doc_id string, length long, norm double",
}
VERSION = 1
#: Keys that change from run to run and are left out of digests.
VOLATILE = frozenset({"created", "host", "duration_s"})


def describe_schema() -> str:
    return "\n".join(f"{name}: {ddl}" for name, ddl in SCHEMAS.items())


def environment() -> dict:
    return {"python": platform.python_version(), "spark": pyspark.__version__, "machine": platform.machine(), "float": check_float_environment()}


def canonical_json(value) -> str:
    """Sorted keys; numbers that are not finite become null."""

    def safe(v):
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            return None
        if isinstance(v, dict):
            return {str(k): safe(x) for k, x in v.items()}
        return [safe(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(safe(value), sort_keys=True, ensure_ascii=False)


def strip_volatile(value):
    if isinstance(value, dict):
        return {k: strip_volatile(v) for k, v in value.items() if k not in VOLATILE}
    return [strip_volatile(v) for v in value] if isinstance(value, list | tuple) else value


@dataclass(frozen=True)
class Manifest:
    """What made a result: inputs, configuration, environment, digests."""

    command: str
    config: dict
    digests: dict = field(default_factory=dict)
    environment: dict = field(default_factory=environment)

    def to_dict(self) -> dict:
        return {"version": VERSION, "command": self.command, "config": self.config, "digests": self.digests, "environment": self.environment}

    def digest(self) -> str:
        import hashlib

        return hashlib.sha256(canonical_json(strip_volatile(self.to_dict())).encode()).hexdigest()


    def require_reproducible(self) -> Manifest:
        """The manifest, if every input and output has a digest; else an error."""
        lost = [k for k, v in self.digests.items() if not v]
        if lost or not self.digests:
            raise BadData(f"no digest of {', '.join(lost) or 'anything'}")
        return self


def write_atomic(path: str, content: str) -> None:
    """A local file that is whole or not there: written beside its place, synced,
    and then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, beside = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise


def write_json(path: str, value) -> None:
    write_atomic(path, canonical_json(value) + "\n")


def write_jsonl_file(path: str, rows) -> None:
    write_atomic(path, "".join(canonical_json(r) + "\n" for r in rows))


def _text(spark: SparkSession, path: str, content: str | None = None) -> str | None:
    """Read or write one small text through Hadoop's file systems."""
    if content is None:
        return "\n".join(r[0] for r in spark.read.text(path).collect())
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return None


def save_model(model: Model, path: str) -> Manifest:
    spark = model.vocab.sparkSession
    for name, ddl in SCHEMAS.items():
        df = getattr(model, name)
        df.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in ddl.split(", ")]).write.mode("overwrite").parquet(f"{path}/{name}")
    m = Manifest("save", {"n_documents": model.n_documents, "reduction": model.reduction.value}, {"model": model.digest()})
    _text(spark, f"{path}/manifest", canonical_json(m.to_dict()))
    return m


def load_model(spark: SparkSession, path: str, verify: bool = True) -> Model:
    """Read a model and check what it claims; broken ones raise ``BadData``."""
    try:
        meta = json.loads(_text(spark, f"{path}/manifest") or "")
        tables = {n: spark.read.schema(ddl).parquet(f"{path}/{n}") for n, ddl in SCHEMAS.items()}
    except BadData:
        raise
    except Exception as e:
        raise BadData(f"no model at {path}: {e}") from e
    if meta.get("version") != VERSION:
        raise BadData(f"model version {meta.get('version')}")
    model = Model(tables["vocab"], tables["weights"], tables["stats"], meta["config"]["n_documents"], Reduction(meta["config"]["reduction"]))
    for problem, rows in problems(model).items():
        if rows.head(1):
            raise BadData(problem)
    if verify and model.digest() != meta["digests"]["model"]:
        raise BadData("the tables are not those that were saved")
    return model


def problems(model: Model) -> dict[str, DataFrame]:
    """Rows that break a rule, by rule."""
    v, w, s = model.vocab, model.weights, model.stats
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return {
        "duplicate token": v.groupBy("token").count().where("count > 1"),
        "duplicate document": s.groupBy("doc_id").count().where("count > 1"),
        "duplicate weight": w.groupBy("doc_id", "token").count().where("count > 1"),
        "frequency out of range": v.where((F.col("df") < 1) | (F.col("df") > model.n_documents) | (F.col("cf") < F.col("df"))),
        "number that is not finite or negative": w.where(bad("weight") | bad("tf") | (F.col("weight") < 0)).select("token").union(v.where(bad("idf")).select("token")),
        "norm that is not finite or negative": s.where(bad("norm") | (F.col("norm") < 0)),
        "weight of an unknown token": w.join(v, "token", "left_anti"),
        "weight of an unknown document": w.join(s, "doc_id", "left_anti"),
    }
