"""Generic SCD type-2 diff of a change list against active history rows.

For each change joined (left) to the person's active row(s):

* no active row (or an active row without a value) -> open a new record;
* value differs (null-safe) -> close the active row at the change date and
  open a new one;
* same value -> nothing.

The join runs once; each joined row emits 0, 1 or 2 output records through
one ``explode`` of a filtered array, so there is no union of two scans.
A person with several active rows fans out exactly like the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.operators.sequence import neighbour_in_group

CLOSE, OPEN = "fechar", "abrir"


def scd2_diff(
    changes: DataFrame,
    active: DataFrame,
    key: str,
    change_date: str,
    new_cmp: str,
    cur_cmp: str,
    new_payload: dict[str, Column],
    cur_payload: dict[str, Column],
    active_id: str = "id",
    active_start: str = "start_date",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Return ``(id, key, start_date, end_date, <payload...>, acao, *carry)`` rows.

    ``new_payload`` / ``cur_payload`` map output column -> expression over the
    joined row for the opened / closed record; both must have the same keys.
    ``active`` must already be restricted to active rows and carry
    ``active_id``, ``active_start`` and the ``cur_cmp`` column.
    """
    if list(new_payload) != list(cur_payload):
        raise ValueError("open and close payloads must have the same columns")
    a = active.select(
        F.col(key).alias("_akey"),
        F.col(active_id).alias("_aid"),
        F.col(active_start).alias("_astart"),
        *[F.col(c) for c in active.columns if c not in (key, active_id, active_start)],
    )
    j = changes.join(a, changes[key] == a["_akey"], "left")
    cur, new = F.col(cur_cmp), F.col(new_cmp)
    has_cur = cur.isNotNull()
    changed = has_cur & ~cur.eqNullSafe(new)
    date = F.col(change_date)

    def record(kind: str, rid: Column, start: Column, end: Column, payload: dict[str, Column]) -> Column:
        fields = [rid.cast("long").alias("id"), F.col(key).alias(key), start.alias("start_date"), end.alias("end_date")]
        fields += [v.alias(k) for k, v in payload.items()]
        fields += [F.lit(kind).alias("acao")] + [F.col(c).alias(c) for c in carry]
        return F.struct(*fields)

    close = F.when(changed, record(CLOSE, F.col("_aid"), F.col("_astart"), date, cur_payload))
    opened = F.when(
        ~has_cur | changed,
        record(OPEN, F.lit(None), date, F.lit(None).cast(changes.schema[change_date].dataType), new_payload),
    )
    out = j.select(F.explode(F.filter(F.array(close, opened), lambda r: r.isNotNull())).alias("r"))
    return out.select("r.*")


def scd2_chain(
    changes: DataFrame,
    active: DataFrame,
    key: str,
    change_date: str,
    new_cmp: str,
    cur_cmp: str,
    new_payload: dict[str, Column],
    cur_payload: dict[str, Column],
    active_id: str = "id",
    active_start: str = "start_date",
    carry: Sequence[str] = (),
    tie: str | None = None,
) -> DataFrame:
    """The changes of a key in order (``change_date``, then ``tie``), as records that follow each other.

    Successive changes to the same value (null-safe) are one: the first of such
    an island opens a record, which the next island's date ends. The first
    island that differs from the key's active value also closes the active row;
    an island before it that equals the active value changes nothing. Without an
    active value the first island only opens. Of several active rows of a key
    the latest start (then id) counts. A null key never matches and is left out.
    Arguments and columns are those of ``scd2_diff``.
    """
    if list(new_payload) != list(cur_payload):
        raise ValueError("open and close payloads must have the same columns")
    date, order = F.col(change_date), [change_date, *([tie] if tie else [])]
    day = F.to_date(change_date)
    latest = F.struct(F.col(active_start), F.col(active_id))
    rest = [c for c in active.columns if c not in (key, active_id, active_start)]
    a = active.where(F.col(key).isNotNull() & F.col(cur_cmp).isNotNull()).groupBy(F.col(key).alias("_akey")).agg(
        F.max_by(F.struct(F.col(active_id).alias("_aid"), F.col(active_start).alias("_astart"), *[F.col(c) for c in rest]), latest).alias("_a")
    ).select("_akey", "_a.*")
    rows = changes.where(F.col(key).isNotNull() & date.isNotNull()).withColumn("_value", F.struct(F.col(new_cmp).alias("v")))
    rows = neighbour_in_group(rows, key, order, "_value", "_before", day, back=True)
    j = rows.join(a, rows[key] == a["_akey"], "left")
    current = F.when(F.col(cur_cmp).isNotNull(), F.struct(F.col(cur_cmp).cast(changes.schema[new_cmp].dataType).alias("v")))
    before = F.coalesce(F.col("_before"), current)
    heads = j.where(before.isNull() | ~F.col("_value.v").eqNullSafe(before["v"])).withColumn("_date", date)
    heads = neighbour_in_group(heads, key, order, "_date", "_until", day, back=False)
    heads = neighbour_in_group(heads, key, order, "_date", "_since", day, back=True)

    def record(kind: str, rid: Column, start: Column, end: Column, payload: dict[str, Column]) -> Column:
        fields = [rid.cast("long").alias("id"), F.col(key).alias(key), start.alias("start_date"), end.alias("end_date")]
        fields += [v.alias(k) for k, v in payload.items()]
        return F.struct(*fields, F.lit(kind).alias("acao"), *[F.col(c).alias(c) for c in carry])

    ends = F.col("_since").isNull() & F.col("_aid").isNotNull()
    close = F.when(ends, record(CLOSE, F.col("_aid"), F.col("_astart"), date, cur_payload))
    opened = record(OPEN, F.lit(None), date, F.col("_until"), new_payload)
    out = heads.select(F.explode(F.filter(F.array(close, opened), lambda r: r.isNotNull())).alias("r"))
    return out.select("r.*")
