"""Models in text files: profiles, substitution models, priors; read on the driver, broadcast to kernels."""

from __future__ import annotations

from pyspark.sql import SparkSession

from reedbank.kernels.dirichlet import Prior
from reedbank.kernels.hmm import Profile, read_profile, write_profile
from reedbank.kernels.models import Model, read_model, write_model
from reedbank.sources.tables import check_program_line, program_line


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, from any place that Spark reads."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).toLocalIterator())


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _own(text: str) -> str:
    """Refuses a text that another program or a later version has signed."""
    if text.startswith("# "):
        check_program_line(text.split("\n", 1)[0])
    return text


def load_profile(spark: SparkSession, path: str) -> Profile:
    return read_profile(_own(read_text(spark, path)))


def save_profile(spark: SparkSession, profile: Profile, path: str) -> None:
    write_text(spark, write_profile(profile), path)


def load_model(spark: SparkSession, path: str) -> Model:
    return read_model(_own(read_text(spark, path)))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    write_text(spark, program_line("substitution model") + "\n" + write_model(model), path)


def load_prior(spark: SparkSession, path: str) -> Prior:
    return Prior.read(_own(read_text(spark, path)))


def save_prior(spark: SparkSession, prior: Prior, path: str) -> None:
    write_text(spark, program_line("priors") + "\n" + prior.write(), path)
