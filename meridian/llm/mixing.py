"""Mixing sources to target weights by capped water-filling.

Source s of size b_s and weight w_s gets min(m * b_s, L * w_s) of the budget B,
for the level L at which these add up to B (m: most epochs).  Raising the level
clamps sources in the order of m * b_s / w_s, and what a clamped source can't
take goes to the others in proportion; so the sources are sorted by that ratio
and the level follows from running sums, without a loop.  A source's epochs
e = share / b_s become whole repetitions and a seeded fraction: a document has
floor(e) copies, and one more if its hash lies below the rest.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.plans.materialize import materialize

MAX_EPOCHS = 4
SEED = 17
#: Most sources that are sent to every executor; with more, documents are shuffled to their source.
BROADCAST_SOURCES = 100_000


def whole_weights(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in the same proportions, exactly as long as they have up to twelve digits, else to twelve digits."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) and math.isfinite(w) else Fraction(w) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("weights can't be negative")
    common = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    whole = {s: int(w * common) for s, w in exact.items()}
    shared = math.gcd(*whole.values()) or 1
    most = max(whole.values(), default=0) // shared
    if most < 10**12:
        return {s: w // shared for s, w in whole.items()}
    return {s: max(1, round(Fraction(w, shared) * 10**12 / most)) if w else 0 for s, w in whole.items()}


def source_epochs(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict[str | None, float] | None = None, max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """(source, size, weight, epochs) for each source, a null one included.

    size is in UTF-8 bytes.  weights are numbers in any unit, fractions too, of
    which only the proportions count (ValueError if one is negative or not
    finite); by default the square root of the size (sources not named have
    weight 0 and epochs 0); budget is in bytes, by default the size of all
    documents.  A source whose texts are all null or empty costs nothing and has
    1 epoch.  If all sources are clamped the budget isn't reached.
    """
    sizes = docs.select(F.col(source_col).alias("source"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("b")).groupBy("source").agg(F.sum("b").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.floor(F.sqrt("size")))
    else:
        given = docs.sparkSession.createDataFrame(list(whole_weights(weights).items()), "s string, w long")
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "size", F.coalesce("w", F.lit(0)).alias("weight"))
    weighed = materialize(weighed, "sources")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("cap_ratio", F.col("source").asc_nulls_first())
    filled = (
        weighed.where("size > 0 and weight > 0")
        .withColumn("cap_ratio", F.expr(f"{max_epochs}D * size / weight"))
        .withColumn("before", F.coalesce(F.sum(F.expr(f"{max_epochs} * size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    )
    total = F.lit(budget) if budget is not None else F.lit(weighed.agg(F.sum("size")).first()[0])
    levels = filled.withColumn("room", (total - F.col("before")).cast("double")).withColumn("fits", F.expr("room / left <= cap_ratio"))
    first = F.min(F.when(F.col("fits"), F.struct("cap_ratio", "source", "room", "left"))).over(everything.partitionBy(F.lit(0)))
    shares = levels.withColumn("first", first).select("source", F.expr(f"case when first is null or cap_ratio < first.cap_ratio or first.room / first.left >= cap_ratio then {max_epochs}D else greatest(0D, first.room * weight / (cast(first.left as double) * size)) end").alias("epochs"))
    return weighed.alias("a").join(shares.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "a.size", "a.weight", F.expr("case when size = 0 then 1D else coalesce(epochs, 0D) end").alias("epochs"))


def _copies(docs: DataFrame, epochs: DataFrame, id_col: str, source_col: str, seed: int) -> tuple[DataFrame, F.Column, str]:
    """docs with their source's epochs under a free name, and the number of copies."""
    own = materialize(epochs.select(F.col("source").alias("own_source"), F.col("epochs").alias("own_epochs")), "epochs")
    small = own.count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(own) if small else own, docs[source_col].eqNullSafe(own["own_source"]))
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    whole = F.floor(own["own_epochs"])
    return joined, (whole + F.when(chance < own["own_epochs"] - whole, 1).otherwise(0)).cast("int"), "own_epochs"


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, max_epochs: int = MAX_EPOCHS, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """The sampled corpus as (doc_id, source, copy), copy counting from 0.

    Nulls: a null source is a source of its own; a null text has size 0; a null
    id is sampled as an empty one.  Empty texts add nothing to their source's
    size, and are sampled as its others; very long ones count by their bytes.
    Ties in the order of clamping go by the source's name.  Repeated rows, and
    rows with one id, are sampled alike, each of them.  An empty table gives no
    rows.  Other columns are not read.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    joined, copies, _ = _copies(named, source_epochs(docs, source_col, text_col, weights, max_epochs, budget), "doc_id", "source", seed)
    return joined.select(named["doc_id"], named["source"], copies.alias("n")).where("n > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, max_epochs: int = MAX_EPOCHS, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as mix() has it; all columns are kept, whatever their names.

    Nulls, empty and very long texts, ties, repeated rows and the empty table:
    as in mix().
    """
    joined, copies, _ = _copies(docs, source_epochs(docs, source_col, text_col, weights, max_epochs, budget), id_col, source_col, seed)
    times = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))
    own, copy = [docs[f"`{c}`"] for c in docs.columns], "_" + max(docs.columns, key=len)  # longer than any name
    return joined.select(*own, times.alias(copy)).drop(copy)


#: The default mix in DuckDB SQL, over whole tables.
ORACLE_SQL = f"""
with sizes as (
  select source, sum(coalesce(strlen(text), 0))::bigint as size from documents group by source
), weighed as (
  select *, floor(sqrt(size::double))::bigint as weight from sizes
), sorted as (
  select *, {MAX_EPOCHS}::double * size / weight as cap_ratio,
    coalesce(sum({MAX_EPOCHS} * size) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as before,
    (sum(weight) over (o rows between current row and unbounded following))::bigint as rest,
    (select sum(size) from weighed)::bigint as budget
  from weighed where size > 0 and weight > 0
  window o as (order by {MAX_EPOCHS}::double * size / weight, source nulls first)
), level as (
  select (budget - before)::double as room, rest, cap_ratio from sorted
  where (budget - before)::double / rest <= cap_ratio order by cap_ratio, source nulls first limit 1
), shares as (
  select s.source, case when l.room is null or s.cap_ratio < l.cap_ratio or l.room / l.rest >= s.cap_ratio then {MAX_EPOCHS}::double
    else greatest(0::double, l.room * s.weight / (l.rest::double * s.size)) end as epochs
  from sorted s left join level l on true
), epochs as (
  select w.source, case when w.size = 0 then 1::double else coalesce(s.epochs, 0::double) end as epochs
  from weighed w left join shares s on s.source is not distinct from w.source
), copies as (
  select d.doc_id, d.source, (floor(e.epochs) + case when
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint / 4294967296::double < e.epochs - floor(e.epochs) then 1 else 0 end)::int as n
  from documents d join epochs e on e.source is not distinct from d.source
)
select doc_id, source, unnest(range(n))::int as copy from copies
"""
