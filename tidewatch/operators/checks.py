"""Data-quality checks: each gives its offending rows; many are counted in one pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import CLASSES, Params
from .joins import join_ahead
from .labels import future_block


@dataclass(frozen=True)
class Check:
    """A table and the condition of its offenders, or a frame of offenders."""

    name: str
    df: DataFrame
    offends: Column | None = None

    def offenders(self) -> DataFrame:
        return self.df if self.offends is None else self.df.where(self.offends)


def run_all(checks: list[Check]) -> DataFrame:
    """(check, offenders): the row checks of a table share one aggregation."""
    by_table: dict[int, list[Check]] = {}
    for c in checks:
        by_table.setdefault(id(c.df) if c.offends is not None else id(c), []).append(c)
    parts = []
    for group in by_table.values():
        if group[0].offends is None:
            parts.append(group[0].df.agg(F.count("*").alias("offenders")).select(F.lit(group[0].name).alias("check"), "offenders"))
        else:
            sums = group[0].df.agg(*(F.count_if(c.offends).alias(c.name) for c in group))
            parts.append(sums.unpivot([], [c.name for c in group], "check", "offenders"))
    return reduce(DataFrame.unionByName, parts)


class CheckFailed(ValueError):
    pass


def enforce(check: Check, mode: str = "fail") -> DataFrame | None:
    """fail: raise if there are offenders; warn: return them; quarantine: return the rows without them."""
    if mode == "fail":
        if not check.offenders().isEmpty():
            raise CheckFailed(check.name)
        return None
    if mode == "warn":
        return check.offenders()
    if check.offends is None:
        raise ValueError("only row checks can set rows aside")
    return check.df.where(~F.coalesce(check.offends, F.lit(False)))


def chain_checks(meas: DataFrame, fut: DataFrame, p: Params) -> list[Check]:
    """Checks of measurements and of labelled rows; the latter have all columns of features and labels, so one aggregation serves them all."""
    rule, status = F.col("rule"), F.col("status_now")
    extreme = (F.col("robust_z") >= p.z_fail) & (F.col("increase_pct") >= (p.floor if p.floor is not None else float("-inf")))
    return [
        Check("positive_rtt", meas, F.col("rtt") <= 0),
        Check("periods", meas, ~F.col("period").isin("A", "B")),
        Check("unique_keys", meas.groupBy("flow_id", "t").agg(F.count("*").alias("n")).where("n > 1")),
        Check("no_period_a", fut, F.col("period") == "A"),
        Check("min_le_mean", fut, (F.col("min5_z") > F.col("mean5_z") + 1e-9) | (F.col("min5_z") > F.col("robust_z"))),
        Check("rule_class", fut, rule.isNull() | ~rule.between(1, 6) | ((status == "FAIL") != (rule <= 4)) | ((status == "RISK") != (rule == 5))),
        Check("loss_is_fail", fut, (F.col("loss_pct") >= p.loss_fail) & (status != "FAIL")),
        Check("rule3_both", fut, (rule == 3) & ~F.coalesce(extreme, F.lit(False))),
        Check("ok_not_extreme", fut, (status == "OK") & extreme),
        Check("future_in_gate", fut, F.col("status_future").isNotNull() != F.coalesce(F.col("delta_s").between(*p.gate), F.lit(False))),
    ]


def expected_counts(df: DataFrame, expected: dict[str, int], columns: dict[str, Column]) -> DataFrame:
    """(name, expected, found) where a count of the table differs from what is expected."""
    found = df.agg(*(c.alias(n) for n, c in columns.items())).unpivot([], list(columns), "name", "found")
    want = F.create_map(*(x for n, v in expected.items() for x in (F.lit(n), F.lit(v))))
    return found.withColumn("expected", want[F.col("name")]).where("expected <> found")


def same_schema(a: DataFrame, b: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """Columns whose names or types differ: a schema is metadata, no job runs."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return [(c, x.get(c), y.get(c)) for c in dict.fromkeys([*x, *y]) if x.get(c) != y.get(c)]


def future_by_join(fut: DataFrame, p: Params) -> DataFrame:
    """Rows whose future label differs from that of a join on positions."""
    other = join_ahead(fut, p.horizon, "status_now").select("flow_id", "t", "ahead", "t_ahead")
    both = fut.select("flow_id", "t", "status_future").join(other, ["flow_id", "t"], "full_outer")
    gap = F.col("t_ahead").cast("timestamp").cast("long") - F.col("t").cast("timestamp").cast("long")
    return both.where(~F.col("status_future").eqNullSafe(F.when(gap.between(*p.gate), F.col("ahead"))))


def future_leaves_block(blk: DataFrame, k: int) -> DataFrame:
    """Rows kept for learning whose future lies in another block."""
    from .labels import gap_flag

    kept = gap_flag(future_block(blk, k), k).where("status_future IS NOT NULL AND NOT in_gap AND block <> 'test'")
    return kept.where("block <> future_block")


def all_classes_present(df: DataFrame, by: str, label: str) -> DataFrame:
    """Groups that lack a class."""
    return df.groupBy(by).agg(F.array_except(F.array(*map(F.lit, CLASSES)), F.collect_set(label)).alias("missing")).where(F.size("missing") > 0)


def select_features(df: DataFrame, wanted: tuple[str, ...], hidden: tuple[str, ...]) -> DataFrame:
    """The model's columns; a column that is neither wanted nor hidden is an error."""
    undecided = [c for c in df.columns if c not in (*wanted, *hidden)]
    missing = [c for c in wanted if c not in df.columns]
    if undecided or missing:
        raise ValueError(f"undecided columns: {undecided}; missing columns: {missing}")
    return df.select(*wanted)


def one_hot(df: DataFrame, col: str, categories: list) -> DataFrame:
    """A 0/1 column for each category of the training rows; unseen values get zeros."""
    return df.select("*", *(F.coalesce((F.col(col) == v).cast("double"), F.lit(0.0)).alias(f"{col}_{v}") for v in categories))


def weights(df: DataFrame, col: str, by_class: dict[str, float]) -> DataFrame:
    out = F.lit(None).cast("double")
    for c, w in by_class.items():
        out = F.when(F.col(col) == c, w).otherwise(out)
    return df.withColumn("weight", out)


#: Legal values of a model row's columns.
ROW_RULES = {
    "loss_pct": lambda c: c.between(0, 100),
    "is_timeout": lambda c: c.isin(0, 1),
    **{f"n5_{x}": (lambda c: c.between(0, 5) & (c == F.floor(c))) for x in ("timeout", "increase80", "moderate")},
}


def model_row_errors(df: DataFrame) -> DataFrame:
    """Adds errors: the names of all columns of a row with illegal values; null is legal, other columns must be finite."""
    def bad(c: str) -> Column:
        x = F.col(c).cast("double")
        ok = ~F.isnan(x) & (F.abs(x) < float("inf"))
        return x.isNotNull() & ~(ok & ROW_RULES[c](x) if c in ROW_RULES else ok)

    return df.withColumn("errors", F.array_compact(F.array(*(F.when(bad(c), F.lit(c)) for c in df.columns))))


def strict_decode(df: DataFrame, schema: str) -> DataFrame:
    """Adds row (struct or null) and errors: not an object, unknown columns, wrong types."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fieldNames()
    row = F.from_json("json", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    keys = F.json_object_keys("json")
    out = df.withColumn("row", row)
    errors = F.concat(
        F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda k: F.concat(F.lit("unknown: "), k))),
        F.when(keys.isNotNull() & F.col("row._bad").isNotNull(), F.array(F.lit("wrong type"))).otherwise(F.array().cast("array<string>")),
    )
    return out.withColumn("errors", errors)
