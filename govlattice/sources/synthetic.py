"""Synthetic people with structurally valid numbers, keyed by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlattice.functions.text import _check_digit
from govlattice.rules.personal_data import CPF_WEIGHTS

# The pools the generator draws from.
FIRST_NAMES = ["Ana", "Bruno", "Carla", "Daniel", "Elisa", "Fábio", "Gabriela", "Hugo", "Isabela", "João"]
LAST_NAMES = [
    "Silva", "Souza", "Oliveira", "Pereira", "Costa", "Rodrigues", "Almeida", "Nascimento", "Lima", "Araújo",
]
EMAIL_DOMAINS = ["exemplo-sintetico.test", "dados-ficticios.test", "synthetic-mail.test"]
AREA_CODES = [11, 21, 31, 41, 51, 61]


def synthetic_people(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` people; the same seed gives the same people however they are partitioned."""
    if n < 0:
        raise ValueError("n must not be negative")
    return with_person(spark.range(n), F.col("id"), seed)


def with_person(df: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    """Add a synthetic person to every row, drawn from a hash of its key."""

    def draw(salt: str, size: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(size)).cast("int")

    def pick(salt: str, values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), draw(salt, len(values)))

    base = F.array(*[draw(f"digit{i}", 10) for i in range(9)])
    staged = df.withColumns(
        {"_first": pick("first", FIRST_NAMES), "_last": pick("last", LAST_NAMES), "_d": base}
    )
    staged = staged.withColumn(
        "_d", F.concat("_d", F.array(_check_digit(F.col("_d"), CPF_WEIGHTS[0]).cast("int")))
    )
    staged = staged.withColumn(
        "_d", F.concat("_d", F.array(_check_digit(F.col("_d"), CPF_WEIGHTS[1]).cast("int")))
    )
    text = F.array_join(F.col("_d").cast("array<string>"), "")
    cpf = F.regexp_replace(text, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")
    email = F.concat(
        F.lower("_first"),
        F.lit("."),
        F.lower("_last"),
        (draw("mail", 999) + 1).cast("string"),
        F.lit("@"),
        pick("domain", EMAIL_DOMAINS),
    )
    phone = F.concat(
        F.lit("("),
        pick("area", AREA_CODES).cast("string"),
        F.lit(") 9"),
        (draw("p1", 9000) + 1000).cast("string"),
        F.lit("-"),
        (draw("p2", 9000) + 1000).cast("string"),
    )
    return staged.withColumns(
        {
            "name": F.concat_ws(" ", "_first", "_last"),
            "cpf": cpf,
            "email": email,
            "phone": phone,
            "synthetic": F.lit(True),
        }
    ).drop("_first", "_last", "_d")
