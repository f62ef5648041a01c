"""Steps of cases through a state machine that refuses, with overrides that are used once.

A step moves its case to another state if the table of moves allows it from the state the case is in, or
if it names an override of the case that is active, signed, justified and not yet used; then the override
is used. Any other step is refused and leaves the state as it was.

So a step is a map from each state to a state, and maps compose. Sorted steps are dealt into segments of
bounded length wherever a case ends; each segment's maps compose to one, in parallel; one pass over the
segments of a case gives each the state it begins in; then all segments are replayed in parallel. Only
steps that name an override which other steps name too depend on more than the state: each of them is a
segment of its own, and the pass over the segments decides it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .linkage import written

#: Steps of a segment, as a power of two.
SEGMENT_BITS = 12
OUT = ("from_state", "outcome", "state_after")


def usable(overrides: DataFrame) -> Column:
    """An override that may be used: active, signed by someone and justified."""
    return (F.col("status") == "active") & (F.coalesce("signed_by", F.lit("")) != "") & (F.coalesce("justification", F.lit("")) != "")


def _next(state: Column, to: Column, free: Column, moves: dict[str, Sequence[str]]) -> Column:
    allowed = F.create_map(*[x for a, b in moves.items() for x in (F.lit(a), F.array(*map(F.lit, b)).cast("array<string>"))])
    return F.when(free | F.coalesce(F.array_contains(F.element_at(allowed, state), to), F.lit(False)), to).otherwise(state)


def replay(steps: DataFrame, case: str, order: Sequence[str], to: str, start: str, moves: dict[str, Sequence[str]], overrides: DataFrame | None = None, override: str | None = None) -> DataFrame:
    """Each step with ``from_state``, ``outcome`` (moved, overridden, refused, invalid-override) and
    ``state_after``; columns of these names are replaced.

    ``moves`` lists the states that each state may go to. ``overrides`` has ``override_id``, the case
    column, ``status``, ``signed_by`` and ``justification``; ``override`` names the column of the id that a
    step gives. An override of another case, or one that isn't usable, is invalid, as is a used one. Of
    overrides with equal ids in a case any usable one counts, once. Cases begin in ``start``. Steps of
    equal order are ordered by target state and override. A null target state is refused; steps of a null
    case are one case. Any case may hold any share of the steps.
    """
    states = sorted({start, *moves, *(b for to_ in moves.values() for b in to_)})
    keys = ["_case", *[f"_o{i}" for i in range(len(order))], "_to", "_override"]
    named = F.col(override).cast("string") if override else F.lit(None).cast("string")
    rows = steps.select(F.struct("*").alias("_row"), F.col(case).cast("string").alias("_case"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(to).cast("string").alias("_to"), named.alias("_override"))
    rows = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    if overrides is None or override is None:
        rows = rows.withColumns({"_free": F.lit(False), "_contested": F.lit(False)})
    else:
        good = overrides.where(usable(overrides)).select(F.col(case).cast("string").alias("_case"), F.col("override_id").cast("string").alias("_override")).distinct()
        uses = rows.where("_override IS NOT NULL").groupBy("_case", "_override").agg(F.count("*").alias("_uses"))
        known = uses.join(good.withColumn("_c", F.col("_case")), uses["_case"].eqNullSafe(good["_case"]) & (uses["_override"] == good["_override"])).select(uses["_case"], uses["_override"], "_uses")
        r = rows.alias("r").join(known.alias("k"), F.col("r._case").eqNullSafe(F.col("k._case")) & (F.col("r._override") == F.col("k._override")), "left")
        rows = r.select("r.*", (F.coalesce("_uses", F.lit(0)) == 1).alias("_free"), (F.coalesce("_uses", F.lit(0)) > 1).alias("_contested"))
    # A segment is a run of steps of one case inside a block of 2^SEGMENT_BITS places, cut at contested steps.
    block = F.shiftright("_at", SEGMENT_BITS)
    local = Window.partitionBy("_case", "_block").orderBy("_at")
    cuts = F.sum((F.col("_contested") | F.coalesce(F.lag("_contested").over(local), F.lit(False))).cast("int")).over(local)
    rows = written(rows.withColumn("_block", block).withColumn("_cut", cuts))
    step = F.struct("_at", "_to", "_free")
    identity = F.array(*map(F.lit, states), F.lit(None)).cast("array<string>")  # null: any state that no move names
    composed = F.aggregate(F.array_sort(F.collect_list(step)), identity, lambda m, s: F.transform(m, lambda x: F.when(s["_to"].isNull(), x).otherwise(_next(x, s["_to"], s["_free"], moves))))
    segments = rows.groupBy("_case", "_block", "_cut").agg(F.min("_at").alias("_first"), composed.alias("_map"), F.max(F.when(F.col("_contested"), F.struct("_to", "_override"))).alias("_contest"))
    segments = segments.select("_case", "_block", "_cut", "_first", "_map", F.col("_contest._to").alias("_to"), F.col("_contest._override").alias("_override"))
    place, allowed = {s: i for i, s in enumerate(states)}, {a: frozenset(b) for a, b in moves.items()}

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state before each segment, and whether its contested override is still there."""
        case_, begun, state, used = None, False, start, set()
        for batch in batches:
            out: list[tuple[str, bool]] = []
            c, maps, targets, overrides_ = (batch.column(i).to_pylist() for i in (0, 4, 5, 6))
            for k in range(batch.num_rows):
                if not begun or c[k] != case_:
                    case_, begun, state, used = c[k], True, start, set()
                out.append((state, overrides_[k] is not None and overrides_[k] not in used))
                if overrides_[k] is None:
                    after = maps[k][place.get(state, -1)]
                    state = state if after is None else after
                elif targets[k] is not None:
                    if targets[k] in allowed.get(state, ()):
                        state = targets[k]
                    elif overrides_[k] not in used:
                        used.add(overrides_[k])
                        state = targets[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 2)], pa.array([s for s, _ in out]), pa.array([f for _, f in out])], names=["_case", "_block", "_cut", "_state", "_there"])

    states_ = segments.repartition("_case").sortWithinPartitions("_case", "_first").mapInArrow(begin, "_case string, _block long, _cut long, _state string, _there boolean")
    same = F.col("r._case").eqNullSafe(F.col("b._case")) & (F.col("r._block") == F.col("b._block")) & (F.col("r._cut") == F.col("b._cut"))
    ready = rows.alias("r").join(written(states_).alias("b"), same).select("r.*", "_state", "_there")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, state = None, start
        for batch in batches:
            c, t, o, block_, cut_, free, contested, begins, there = (batch.column(n).to_pylist() for n in ("_case", "_to", "_override", "_block", "_cut", "_free", "_contested", "_state", "_there"))
            before, outcome, after = [], [], []
            for k in range(batch.num_rows):
                if (c[k], block_[k], cut_[k]) != segment:
                    segment, state = (c[k], block_[k], cut_[k]), begins[k]
                before.append(state)
                if t[k] is not None and t[k] in allowed.get(state, ()):
                    outcome.append("moved")
                    state = t[k]
                elif t[k] is not None and (free[k] or contested[k] and there[k]):
                    outcome.append("overridden")
                    state = t[k]
                else:
                    outcome.append("refused" if o[k] is None or t[k] is None else "invalid-override")
                after.append(state)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(before), pa.array(outcome), pa.array(after)], names=["_row", *OUT])

    schema = StructType([StructField("_row", steps.schema), *[StructField(n, StringType()) for n in OUT]])
    out = ready.repartition("_case", "_block", "_cut").sortWithinPartitions("_case", "_at").mapInArrow(run, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in steps.columns if c not in OUT], *OUT)
