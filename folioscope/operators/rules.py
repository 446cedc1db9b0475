"""Rule tables to findings, tiers and catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Rule = tuple[str, str, Column]  # code, level, predicate


def findings(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """(keys, seq, code, level): a row for each rule that holds, in the order of the rules. One pass, no join."""
    made = F.array(*[F.when(holds, F.struct(F.lit(i).alias("seq"), F.lit(code).alias("code"), F.lit(level).alias("level"))) for i, (code, level, holds) in enumerate(rules)])
    return df.select(*keys, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("f")).select(*keys, "f.*")


def codes(rules: Sequence[Rule]) -> Column:
    """The codes of the rules that hold, as an array."""
    return F.filter(F.array(*[F.when(holds, F.lit(code)) for code, _, holds in rules]), lambda x: x.isNotNull())


def tier(found: Column, hard: Sequence[str], unresolved: Column | None = None) -> Column:
    """manual_migration_required for a hard code or something unresolved, converted_with_review for any other code, else converted."""
    blocked = F.arrays_overlap(found, F.array(*[F.lit(x) for x in hard]))
    if unresolved is not None:
        blocked = blocked | (unresolved > 0)
    return F.when(blocked, "manual_migration_required").when(F.size(found) > 0, "converted_with_review").otherwise("converted")


def catalogue(names: DataFrame, key: str, native: DataFrame, curated: DataFrame, substitutes: DataFrame) -> DataFrame:
    """(key, status, replacement): the first of native, curated and substitutes that knows the key, else UNKNOWN.

    native: key. curated: key, canonical. substitutes: key, replacement. These are small dimension tables, left to the
    optimiser's own size check.
    """
    n = native.select(F.col("key").alias(key), F.lit(True).alias("__native"))
    c = curated.select(F.col("key").alias(key), F.col("canonical").alias("__canonical"))
    s = substitutes.select(F.col("key").alias(key), F.col("replacement").alias("__replacement"))
    out = names.select(key).distinct().join(n, key, "left").join(c, key, "left").join(s, key, "left")
    status = F.when(F.col("__native"), "AVAILABLE").when(F.col("__canonical").isNotNull(), "AVAILABLE").when(F.col("__replacement").isNotNull(), "SUBSTITUTED").otherwise("UNKNOWN")
    return out.select(key, status.alias("status"), F.when(F.col("__native"), F.lit(None)).otherwise(F.coalesce("__canonical", "__replacement")).alias("replacement"))


def used_before_made(requests: DataFrame, scope: Sequence[str], seq: str, kind: str, makes: str) -> DataFrame:
    """Requests of a scope that come before its first ``makes`` request, or have none at all; with the place of that."""
    w = Window.partitionBy(*scope)
    made = F.min(F.when(F.col(kind) == makes, F.col(seq))).over(w)
    return requests.withColumn("made_at", made).where((F.col(kind) != makes) & (F.col("made_at").isNull() | (F.col(seq) < F.col("made_at"))))


def plan_problems(requests: DataFrame) -> DataFrame:
    """(page, seq, code) of requests (page, seq, kind, id, target, start, end, length) that cannot be carried out in order.

    kind: create, insert (length units at start), delete (start to end), style (start to end), remove. Text length runs
    along with each object.
    """
    of = Window.partitionBy("page", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("kind") == "insert", F.col("length")).when(F.col("kind") == "delete", F.col("start") - F.col("end")).otherwise(0)
    df = requests.withColumn("__made", F.coalesce(F.sum(F.when(F.col("kind") == "create", 1).when(F.col("kind") == "remove", -1).otherwise(0)).over(of), F.lit(0))).withColumn("__long", F.coalesce(F.sum(change).over(of), F.lit(0)))
    rules = [
        ("unknown_kind", "error", ~F.col("kind").isin("create", "insert", "delete", "style", "remove")),
        ("bad_id", "error", ~F.coalesce(F.rlike("id", F.lit(r"\A[A-Za-z0-9_][A-Za-z0-9_\-:]{4,49}\z")), F.lit(False))),
        ("duplicate_id", "error", (F.col("kind") == "create") & (F.col("__made") > 0)),
        ("missing_target", "error", F.col("kind").isin("insert", "delete", "style", "remove") & (F.col("__made") <= 0)),
        ("index_out_of_range", "error", (F.col("kind") == "insert") & ((F.col("start") < 0) | (F.col("start") > F.col("__long")))),
        ("range_out_of_text", "error", F.col("kind").isin("delete", "style") & ~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("__long")))),
    ]
    return findings(df.withColumn("at", F.col("seq")), ["page", "at"], rules).select("page", F.col("at").alias("seq"), "code")
