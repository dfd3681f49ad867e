"""The quality gate: checks on features against thresholds, and decisions from them.

Checks are rows (sample_id, check_id, evaluation_state, finding, severity, decision_effect, score, reason_code). What was
not evaluated, or is unavailable, has no effect and is no pass. Effects rank pass < warning < retake.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANK = {"pass": 0, "warning": 1, "retake": 2}


@dataclass(frozen=True)
class Rule:
    """A level: `feature` compared by `op` with `limit` has `effect`, for `reason`. Rules of a check are tried in order."""

    feature: str
    op: str
    limit: float
    effect: str
    reason: str

    def __post_init__(self):
        if self.op not in ("<", "<=", ">", ">=") or self.effect not in RANK:
            raise ValueError(f"not a rule: {self}")

    def hit(self) -> Column:
        c = F.col(self.feature)
        return {"<": c < self.limit, "<=": c <= self.limit, ">": c > self.limit, ">=": c >= self.limit}[self.op]


@dataclass(frozen=True)
class Parts:
    """What a check comes to: its state, and if it is evaluated a level (0 pass, 1 warning, 2 retake), finding, severity,
    score, and reasons as (condition, code), of which the first that holds counts at a level above 0."""

    state: Column
    level: Column
    finding: Column
    severity: Column
    score: Column
    reasons: Sequence[tuple[Column, str]]


class Rated:
    """A check: a name, whether it takes part, and its parts. One that is off or deferred has no effect and is not missed."""

    name: str
    enabled: bool
    deferred: bool

    def parts(self) -> Parts:
        raise NotImplementedError

    @property
    def active(self) -> bool:
        return self.enabled and not self.deferred

    def row(self) -> Column:
        """The check's result as a struct."""
        p = self.parts()
        done = p.state == "evaluated"
        return F.struct(
            F.lit(self.name).alias("check_id"), p.state.alias("evaluation_state"), F.when(done, p.finding).alias("finding"), F.when(done, p.severity).alias("severity"),
            F.when(done, _name(p.level)).alias("decision_effect"), p.score.cast("double").alias("score"), F.when(done & (p.level > 0), _first(p.reasons)).alias("reason_code"), F.lit(self.active).alias("active"),
        )


def _first(reasons: Sequence[tuple[Column, str]], code=None) -> Column:
    out = F.lit(None)
    for hit, reason in reversed(reasons):
        out = F.when(hit, F.lit(reason if code is None else code(reason))).otherwise(out)
    return out.cast("string" if code is None else "int")


def _severity(level: Column) -> Column:
    return F.when(level == 2, "severe").when(level == 1, "moderate").otherwise("none")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


@dataclass(frozen=True)
class Check(Rated):
    """`at_least` rules of retake must hit for a retake (fewer make a warning); a check without its features is not evaluated,
    one whose `needs` is not true is unavailable, and one that is off or deferred has no effect."""

    name: str
    rules: Sequence[Rule] = field(default_factory=tuple)
    at_least: int = 1
    decisive: Sequence[str] = ()
    needs: Column | None = None
    enabled: bool = True
    deferred: bool = False
    score: str | None = None

    def parts(self) -> Parts:
        known = _all(F.col(f).isNotNull() for f in dict.fromkeys(r.feature for r in self.rules))
        severe = [r for r in self.rules if r.effect == "retake"]
        hit = _any(r.hit() for r in self.rules)
        if not severe:
            retake = F.lit(False)
        elif self.at_least == 1:
            retake = _any(r.hit() for r in severe)
        else:
            retake = sum((r.hit().cast("int") for r in severe), F.lit(0)) >= self.at_least
        retake = retake | _any(r.hit() for r in severe if r.feature in self.decisive)
        level = F.when(retake, 2).when(hit, 1).otherwise(0)
        if not self.active:
            state = F.lit("not_evaluated")
        else:
            state = F.when(known, "evaluated").otherwise("not_evaluated")
            if self.needs is not None:
                state = F.when(~F.coalesce(self.needs, F.lit(False)), "unavailable").otherwise(state)
        reasons = [(retake & r.hit(), r.reason) for r in severe] + [(r.hit(), r.reason) for r in self.rules]
        score = F.col(self.score) if self.score else F.lit(None)
        return Parts(state, level, F.when(level == 0, "false").otherwise("true"), _severity(level), score, reasons)


@dataclass(frozen=True)
class Step:
    """What holds where `hit` does and no step before it did."""

    hit: Column
    finding: str
    severity: str
    effect: str
    reason: Sequence[tuple[Column, str]] | str | None = None


@dataclass(frozen=True)
class Ladder(Rated):
    """A check whose steps are tried in order; where none hits, `otherwise` is found and it passes. known: whether its
    features are there; available: whether they can be trusted (else the check is unavailable)."""

    name: str
    steps: Sequence[Step]
    otherwise: str
    score: Column
    known: Column | None = None
    available: Column | None = None
    enabled: bool = True
    deferred: bool = False

    def parts(self) -> Parts:
        level, finding, severity = F.lit(0), F.lit(self.otherwise), F.lit("none")
        reasons: list[tuple[Column, str]] = []
        for step in reversed(self.steps):
            level = F.when(step.hit, RANK[step.effect]).otherwise(level)
            finding = F.when(step.hit, step.finding).otherwise(finding)
            severity = F.when(step.hit, step.severity).otherwise(severity)
        for step in self.steps:
            own = [(F.lit(True), step.reason)] if isinstance(step.reason, str) else step.reason or ()
            reasons += [(step.hit & c, code) for c, code in own]
        state = F.lit("evaluated")
        if self.known is not None:
            state = F.when(F.coalesce(self.known, F.lit(False)), state).otherwise("not_evaluated")
        if self.available is not None:
            state = F.when(~F.coalesce(self.available, F.lit(False)), "unavailable").otherwise(state)
        if not self.active:
            state = F.lit("not_evaluated")
        return Parts(state, level, finding, severity, self.score, reasons)


def three_state(name: str, score: str, clear: float, retake: float, reason: str, deferred: bool = False) -> Ladder:
    """A check of a probability with two thresholds: true, uncertain, false."""
    if not clear < retake:
        raise ValueError("the lower threshold is not below the upper")
    p = F.col(score)
    steps = (Step(p <= clear, "false", "none", "pass"), Step(p >= retake, "true", "severe", "retake", reason), Step(F.lit(True), "uncertain", "moderate", "warning", reason))
    return Ladder(name, steps, "uncertain", p, known=p.isNotNull() & ~F.isnan(p), deferred=deferred)


def evaluate(features: DataFrame, checks: Sequence[Rated], key: str = "sample_id") -> DataFrame:
    """All checks of all samples in long form: one pass over the features, no shuffle."""
    items = F.array(*[c.row() for c in checks])
    return features.select(F.col(key).alias("sample_id"), F.posexplode(items).alias("seq", "c")).select("sample_id", "seq", "c.*")


@dataclass(frozen=True)
class Evaluated:
    """Checks of each sample in columns: l<i> a level or null, r<i> the number of a reason or null, u<i> whether it is unavailable."""

    rows: DataFrame
    names: Sequence[str]
    active: Sequence[bool]
    reasons: Sequence[str]
    kept: Sequence[str] = ()

    def of(self, only: Sequence[str] | None) -> list[int]:
        return [i for i, n in enumerate(self.names) if only is None or n in only]

    def worst(self, only: Sequence[str] | None = None) -> Column:
        levels = [F.col(f"l{i}") for i in self.of(only)]
        return F.coalesce(F.greatest(*levels, *levels[:1]), F.lit(0)) if levels else F.lit(0)


def evaluated(features: DataFrame, checks: Sequence[Rated], key: str = "sample_id", keep: Sequence[str] = ()) -> Evaluated:
    """All checks of each sample in columns of numbers: one pass over the features in generated code. keep: columns that stay."""
    parts = [c.parts() for c in checks]
    reasons = list(dict.fromkeys(r for p in parts for _, r in p.reasons))
    columns = []
    for i, (c, p) in enumerate(zip(checks, parts, strict=True)):
        done = p.state == "evaluated"
        columns.append((F.when(done, p.level) if c.active else F.lit(None).cast("int")).alias(f"l{i}"))
        columns.append((F.when(done & (p.level > 0), _first(p.reasons, reasons.index)) if c.active else F.lit(None).cast("int")).alias(f"r{i}"))
        columns.append((p.state == "unavailable" if c.active else F.lit(False)).alias(f"u{i}"))
    return Evaluated(features.select(F.col(key).alias("sample_id"), *keep, *columns), [c.name for c in checks], [c.active for c in checks], reasons, keep)


def _name(worst: Column) -> Column:
    return F.when(worst == 2, "retake").when(worst == 1, "warning").otherwise("pass")


def decide_arrays(samples: Evaluated, priority: Sequence[str] = (), only: Sequence[str] | None = None, nothing: str | None = None, before: Sequence[str] | None = None) -> DataFrame:
    """As decide(), for evaluated() samples: each decision is made within its row, so nothing is shuffled.

    nothing: a check whose retake means that there is nothing to evaluate; before: checks whose decision alone is named too.
    """
    some = samples.of(only)
    names = [*priority, *[r for r in samples.reasons if r not in priority]]
    place = F.array(*[F.lit(names.index(r)) for r in samples.reasons]) if samples.reasons else F.array().cast("array<int>")
    # the number of a reason in the order of priority, those without one all alike, then of the checks
    wide = samples.rows.select("*", *[F.get(place, F.col(f"r{i}")).alias(f"p{i}") for i in some], samples.worst(only).alias("worst"))
    rank = lambda i: (2 - F.col(f"l{i}")) * 1_000_000_000 + F.least(F.col(f"p{i}"), F.lit(len(priority))) * 1_000_000 + F.lit(i * 1000) + F.col(f"p{i}")
    ranks = [F.when(F.col(f"p{i}").isNotNull(), rank(i)) for i in some] or [F.lit(None).cast("int")]
    every = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    first = F.get(every, F.pmod(F.least(*ranks, *ranks[:1]), F.lit(1000)).cast("int"))
    reasons = F.concat_ws("|", F.array_distinct(F.array(*[F.get(every, F.col(f"p{i}")) for i in some]))) if some else F.lit("")
    complete = _all(F.col(f"l{i}").isNotNull() for i, on in enumerate(samples.active) if on)
    if nothing is not None:
        complete = complete & ~(_any(F.col(f"l{i}") == 2 for i in samples.of([nothing])) & (F.col("worst") == 2))
    earlier = [] if before is None else [_name(samples.worst(before)).alias("before")]
    return wide.select("sample_id", _name(F.col("worst")).alias("decision"), first.alias("primary_reason"), reasons.alias("reasons"), (F.col("worst") < 2).alias("usable"), F.coalesce(complete, F.lit(False)).alias("evaluation_complete"), *samples.kept, *earlier)


def ablation_arrays(samples: Evaluated, layers: dict[str, Sequence[str]]) -> DataFrame:
    """As ablation(), for evaluated() samples: one aggregate over the rows as they are."""
    worst = samples.rows.select(*[samples.worst(names).alias(f"w{i}") for i, names in enumerate(layers.values())])
    counts = worst.agg(*[F.count_if(F.col(f"w{i}") == r).alias(f"n{i}_{r}") for i in range(len(layers)) for r in RANK.values()])
    each = [F.struct(F.lit(k).alias("layer"), F.lit(name).alias("decision"), F.col(f"n{i}_{r}").alias("n")) for i, k in enumerate(layers) for name, r in RANK.items()]
    return counts.select(F.explode(F.array(*each)).alias("d")).select("d.*").filter("n > 0")


def ablation_deltas(counts: DataFrame, layers: Sequence[str]) -> DataFrame:
    """(layer, before, delta): how many more retakes each layer of ablation() has than the one before it."""
    n = counts.groupBy(F.lit(1).alias("one")).agg(*[F.coalesce(F.sum(F.when((F.col("layer") == k) & (F.col("decision") == "retake"), F.col("n"))), F.lit(0)).alias(f"n{i}") for i, k in enumerate(layers)])
    each = [F.struct(F.lit(b).alias("layer"), F.lit(a).alias("before"), (F.col(f"n{i + 1}") - F.col(f"n{i}")).alias("delta")) for i, (a, b) in enumerate(zip(layers, layers[1:], strict=False))]
    return n.select(F.explode(F.array(*each)).alias("d")).select("d.*")


def _asked(samples: Evaluated, sources: dict[str, Sequence[str]]) -> DataFrame:
    """Counts of samples by which sources ask for a retake, as a number with a bit for each source."""
    bits = sum((F.when(samples.worst(names) == 2, 1 << j).otherwise(0) for j, names in enumerate(sources.values())), F.lit(0))
    return samples.rows.select(bits.alias("bits")).filter("bits > 0").groupBy("bits").agg(F.count("*").alias("n"))


def attribution_arrays(samples: Evaluated, sources: dict[str, Sequence[str]]) -> DataFrame:
    """As attribution(), for evaluated() samples."""
    names = F.concat_ws("+", *[F.when(F.col("bits").bitwiseAND(1 << j) > 0, k) for j, k in enumerate(sources)])
    bucket = F.when(F.bit_count("bits") == 1, F.concat(names, F.lit("_only"))).otherwise(names)
    return _asked(samples, sources).select(bucket.alias("bucket"), "n")


def attribution_buckets(samples: Evaluated, sources: dict[str, Sequence[str]]) -> DataFrame:
    """(bucket, n): every bucket of the report, with 0 where it is empty: one source only, two of them, three or more, none."""
    keys, spark = list(sources), samples.rows.sparkSession
    buckets = [f"{k}_only" for k in keys] + [f"{a}_plus_{b}" for i, a in enumerate(keys) for b in keys[i + 1 :]] + ["three_or_more", "none"]
    names = F.concat_ws("_plus_", *[F.when(F.col("bits").bitwiseAND(1 << j) > 0, k) for j, k in enumerate(keys)])
    bucket = F.when(F.bit_count("bits") == 1, F.concat(names, F.lit("_only"))).when(F.bit_count("bits") == 2, names).otherwise("three_or_more")
    found = _asked(samples, sources).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    # retakes of checks that no source names
    other = [c for c in samples.names if not any(c in names for names in sources.values())]
    alone = samples.rows.filter((samples.worst(other) == 2) & (samples.worst([c for names in sources.values() for c in names]) < 2)).agg(F.count("*").alias("n")).select(F.lit("none").alias("bucket"), "n")
    every = spark.createDataFrame([(b,) for b in buckets], "bucket string")
    return every.join(F.broadcast(found.unionByName(alone)), "bucket", "left").groupBy("bucket").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))  # a row for each bucket


def unavailable_counts(samples: Evaluated, over: Sequence[str]) -> DataFrame:
    """(why, n) over samples whose evaluation is not complete: for each check of `over` how many have it unavailable, and as
    'other' how many have all of those evaluated and lack another check."""
    active = [i for i, on in enumerate(samples.active) if on]
    complete = _all(F.col(f"l{i}").isNotNull() for i in active)
    named = [i for i in samples.of(over) if samples.active[i]]
    rows = samples.rows.filter(~complete)
    counts = rows.agg(*[F.count_if(F.col(f"u{i}")).alias(f"n{i}") for i in named], F.count_if(_all(F.col(f"l{i}").isNotNull() for i in named)).alias("other"))
    each = [F.struct(F.lit(f"{samples.names[i]}_unavailable").alias("why"), F.col(f"n{i}").alias("n")) for i in named] + [F.struct(F.lit("other").alias("why"), F.col("other").alias("n"))]
    return counts.select(F.explode(F.array(*each)).alias("d")).select("d.*")


def _rank(effect: Column) -> Column:
    return F.when(effect == "retake", 2).when(effect == "warning", 1).when(effect == "pass", 0)


def decide(rows: DataFrame, priority: Sequence[str] = (), only: Sequence[str] | None = None) -> DataFrame:
    """A decision for each sample: the worst effect (pass where there is none), the reasons in order of the checks, the
    primary reason (worst first, then by priority, then by order), whether it is usable, and whether all active checks were
    evaluated (all checks, where the rows have no column `active`)."""
    active = F.col("active") if "active" in rows.columns else F.lit(True)
    if only is not None:
        rows = rows.withColumn("decision_effect", F.when(F.col("check_id").isin(*only), F.col("decision_effect")))
    order = F.lit(len(priority))
    for i, r in reversed(list(enumerate(priority))):
        order = F.when(F.col("reason_code") == r, i).otherwise(order)
    rank = _rank(F.col("decision_effect"))
    reason = F.when(rank > 0, F.col("reason_code"))
    out = rows.groupBy("sample_id").agg(
        F.coalesce(F.max(rank), F.lit(0)).alias("worst"), F.min_by(reason, F.when(reason.isNotNull(), F.struct((-rank).alias("r"), order.alias("o"), F.col("seq")))).alias("primary_reason"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(reason.isNotNull(), F.struct("seq", reason.alias("x"))))), lambda s: s["x"])).alias("reasons"),
        F.bool_and(~active | (F.col("evaluation_state") == "evaluated")).alias("evaluation_complete"),
    )
    name = F.when(F.col("worst") == 2, "retake").when(F.col("worst") == 1, "warning").otherwise("pass")
    return out.select("sample_id", name.alias("decision"), "primary_reason", F.array_join("reasons", "|").alias("reasons"), (F.col("worst") < 2).alias("usable"), "evaluation_complete")


def ablation(rows: DataFrame, layers: dict[str, Sequence[str]]) -> DataFrame:
    """(layer, decision, n): decisions from nested sets of checks, in one aggregation."""
    spark = rows.sparkSession
    member = spark.createDataFrame([(k, c) for k, cs in layers.items() for c in cs], "layer string, check_id string")
    worst = rows.join(F.broadcast(member), "check_id").groupBy("layer", "sample_id").agg(F.coalesce(F.max(_rank(F.col("decision_effect"))), F.lit(0)).alias("w"))  # a few layers
    name = F.when(F.col("w") == 2, "retake").when(F.col("w") == 1, "warning").otherwise("pass")
    return worst.groupBy("layer", name.alias("decision")).agg(F.count("*").alias("n"))


def attribution(rows: DataFrame, sources: dict[str, Sequence[str]]) -> DataFrame:
    """(bucket, n): retakes by which sources of checks asked for them."""
    hit = lambda cs: F.bool_or(F.col("check_id").isin(*cs) & F.coalesce(F.col("decision_effect") == "retake", F.lit(False)))
    flags = rows.groupBy("sample_id").agg(*[hit(cs).alias(k) for k, cs in sources.items()])
    names = F.array_join(F.filter(F.array(*[F.when(F.col(k), k) for k in sources]), lambda x: x.isNotNull()), "+")
    bucket = F.when(names == "", None).when(F.instr(names, "+") == 0, F.concat(names, F.lit("_only"))).otherwise(names)
    return flags.select(bucket.alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def status_breakdown(rows: DataFrame) -> DataFrame:
    """(check_id, status, n), a missing effect as null, for each check and for all."""
    status = F.coalesce("decision_effect", F.lit("null"))
    out = rows.withColumn("status", status).groupingSets([["check_id", "status"], ["status"]], "check_id", "status").agg(F.count("*").alias("n"), F.grouping("check_id").alias("g"))
    return out.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("check_id")).alias("check_id"), "status", "n")


def incomplete_reasons(rows: DataFrame) -> DataFrame:
    """(why, n): samples with an unavailable active check, with one not evaluated, and complete ones."""
    if "active" in rows.columns:
        rows = rows.withColumn("evaluation_state", F.when(F.col("active"), F.col("evaluation_state")).otherwise("off"))
    s = rows.groupBy("sample_id").agg(F.bool_or(F.col("evaluation_state") == "unavailable").alias("u"), F.bool_or(F.col("evaluation_state") == "not_evaluated").alias("n"))
    why = F.when(F.col("u"), "unavailable").when(F.col("n"), "not_evaluated").otherwise("complete")
    return s.groupBy(why.alias("why")).agg(F.count("*").alias("n"))


def reason_counts(decided: DataFrame) -> DataFrame:
    """(reason, n) from the joined lists."""
    each = decided.select(F.explode(F.split("reasons", r"\|")).alias("reason")).filter("reason <> ''")
    return each.groupBy("reason").agg(F.count("*").alias("n"))


def integrity(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Samples whose decision is not the worst of their effects."""
    worst = rows.groupBy("sample_id").agg(F.coalesce(F.max(_rank(F.col("decision_effect"))), F.lit(0)).alias("w"))
    own = F.when(F.col("decision") == "retake", 2).when(F.col("decision") == "warning", 1).otherwise(0)
    return decided.join(worst, "sample_id").filter(own != F.col("w")).select("sample_id", "decision")


def newly_rejected(samples: Evaluated, before: Sequence[str], priority: Sequence[str] = ()) -> DataFrame:
    """Samples that some checks alone let pass, and all checks together do not."""
    some = replace(samples, rows=samples.rows.filter((samples.worst() == 2) & (samples.worst(before) < 2)))
    return decide_arrays(some, priority, before=before)


def ready(checks: Sequence[Rated], calibrated: Sequence[str]) -> tuple[bool, bool]:
    """Whether the gate can be used (some check is active, and every active one is calibrated), and whether it covers every check."""
    active = [c.name for c in checks if c.active]
    return bool(active) and set(active) <= set(calibrated), len(active) == len(checks)


def ranked_candidates(df: DataFrame, keys: dict[str, tuple[bool, float]], name: str) -> DataFrame:
    """Candidates in order of several keys: name -> (whether greater is better, what stands for a missing value)."""
    order = [(F.desc if up else F.asc)(F.coalesce(F.col(c), F.lit(default))) for c, (up, default) in keys.items()]
    return df.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order, name)))  # a row for each candidate
