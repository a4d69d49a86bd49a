"""What is read off finished measures: profiles, findings, boards, comparisons of groups, documents and graphs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..status import q9, ratio, wilson
from .metrics import ranked_counts
from .ordering import kept, running
from .selection import beside, quantiles

#: Slices that are compared pair by pair.
MAX_SLICES = 1000


def one_against_rest(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(label, n_pos, n_neg, auc, ap) of each class's score in df(y_true, scores); null without both kinds, and without positives."""
    each = F.arrays_zip(F.array(*map(F.lit, classes)).alias("label"), F.col("scores").alias("score"))
    rows = df.select("y_true", F.explode(each).alias("x")).select("x.label", "x.score", (F.col("y_true") == F.col("x.label")).alias("is"))
    counts = ranked_counts(rows, "score", F.col("is"), ["label"])
    placed = running(counts, ["score"], {"below": F.col("neg"), "under": F.col("pos") + F.col("neg"), "fewer": F.col("pos")}, ["label"])
    total = kept(counts.groupBy("label").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")))  # a row a class
    met = placed.join(F.broadcast(total), "label")
    rank = F.col("pos") * (F.col("below") + F.col("neg") / 2)
    # from the highest score down to this one: what is not under it
    gain = F.col("pos") * ratio(F.col("n_pos") - F.col("fewer"), F.col("n_pos") + F.col("n_neg") - F.col("under"))
    a = met.groupBy("label", "n_pos", "n_neg").agg(F.sum(rank).alias("rank"), F.sum(gain).alias("gain"))
    return a.select("label", "n_pos", "n_neg", q9(ratio("rank", F.col("n_pos") * F.col("n_neg"))).alias("auc"), q9(ratio("gain", "n_pos")).alias("ap"))


def macro_one_against_rest(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(measure, value, status): means over the classes; UNDEFINED if any class has none."""
    c = one_against_rest(df, classes).agg(F.count("*").alias("n"), *[F.count(m).alias(f"k_{m}") for m in ("auc", "ap")], *[F.avg(m).alias(m) for m in ("auc", "ap")])
    rows = F.array(*[F.struct(F.lit(f"{m}_ovr_macro").alias("measure"), q9(F.when((F.col("n") > 0) & (F.col(f"k_{m}") == F.col("n")), F.col(m))).alias("value")) for m in ("auc", "ap")])
    out = c.select(F.explode(rows).alias("x")).select("x.*")
    return out.withColumn("status", F.when(F.col("value").isNull(), "UNDEFINED").otherwise("COMPUTED"))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; the greatest is taken off first."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def cell_key(c: Column) -> Column:
    """A number's canonical spelling: NaN equals NaN, 1 equals 1.0, null is 'None'."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(c.isNull(), "None").when(F.isnan(c), "nan").when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def timestamp_state(c: Column) -> Column:
    """VALID for an ISO date and time in UTC; otherwise MISSING, NAIVE (no offset), NOT_UTC or NOT_A_TIMESTAMP."""
    base = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?"
    real = F.try_to_timestamp(F.substring(F.regexp_replace(c, "T", " "), 1, 19)).isNotNull()
    return (
        F.when(c.isNull(), "MISSING").when(~c.rlike(base) | ~real, "NOT_A_TIMESTAMP").when(c.rlike(base + r"(Z|[+-]00:?00)$"), "VALID")
        .when(c.rlike(base + r"[+-]\d{2}:?\d{2}$"), "NOT_UTC").when(c.rlike(base + "$"), "NAIVE").otherwise("NOT_A_TIMESTAMP")
    )


def document_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, pointer, change): leaves added, removed and changed between a(key, document) and b, documents being maps of strings.

    Each document is one row a leaf, so the comparison is a join by key and pointer. A key that only one side has gives its leaves.
    """
    leaves = lambda d, v: d.select(key, F.explode("document").alias("pointer", v))
    both = leaves(a, "x").withColumn("in_a", F.lit(True)).join(leaves(b, "y").withColumn("in_b", F.lit(True)), [key, "pointer"], "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return both.select(key, "pointer", change.alias("change")).filter("change is not null")


def binary_measures(df: DataFrame, by: Sequence[str], minimum: int = 10) -> DataFrame:
    """(by..., measure, value, n, status) of a binary predictor: accuracy, precision, recall, F1 of class 1, balanced accuracy, error rate. One pass."""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    c = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    recall, specificity = ratio("tp", F.col("tp") + F.col("fn")), ratio("tn", F.col("tn") + F.col("fp"))
    values = {
        "accuracy": ratio(F.col("tp") + F.col("tn"), "n"), "precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": recall,
        "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "balanced_accuracy": (recall + specificity) / 2, "error_rate": ratio(F.col("fp") + F.col("fn"), "n"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), q9(v).alias("value")) for k, v in values.items()])
    out = c.select(*by, "n", F.explode(rows).alias("x")).select(*by, "x.measure", "x.value", "n")
    return out.withColumn("status", F.when(F.col("value").isNull(), "UNDEFINED").when(F.col("n") < minimum, "INSUFFICIENT_EVIDENCE").otherwise("COMPUTED"))


def slice_pairs(members: DataFrame, measure: str) -> DataFrame:
    """(a, b, n_a, n_b, shared, mean_a, mean_b, difference, status) of members(slice, id, <measure>).

    Groups that share samples are compared in words only: UNDEFINED, as a test of
    independent groups would be invalid. Shared samples are counted by a sample's
    list of slices, never by joining slices with each other. All pairs of slices are
    the result, so that more than MAX_SLICES of them are refused.
    """
    if members.select("slice").distinct().limit(MAX_SLICES + 1).count() > MAX_SLICES:
        raise ValueError(f"more than {MAX_SLICES} slices")
    size = members.groupBy("slice").agg(F.count("*").alias("n"), F.avg(measure).alias("m"))  # a row a slice
    lists = members.groupBy("id").agg(F.sort_array(F.collect_set("slice")).alias("s")).filter(F.size("s") > 1)  # at most as many as there are slices
    both = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    shared = lists.select(F.explode(both).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("shared"))
    left = size.select(F.col("slice").alias("a"), F.col("n").alias("n_a"), F.col("m").alias("mean_a"))
    right = size.select(F.col("slice").alias("b"), F.col("n").alias("n_b"), F.col("m").alias("mean_b"))
    pairs = left.join(right, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return pairs.select(
        "a", "b", "n_a", "n_b", "shared", q9("mean_a").alias("mean_a"), q9("mean_b").alias("mean_b"), q9(F.col("mean_a") - F.col("mean_b")).alias("difference"),
        F.when(F.col("shared") > 0, "UNDEFINED").otherwise("DERIVED").alias("status"),
    )


def group_missingness(df: DataFrame, group: str, reference: str, comparison: str, features: Sequence[str], minimum: int = 30) -> DataFrame:
    """(feature, n_reference, n_comparison, rate_reference, rate_comparison, lower_reference, upper_reference, lower_comparison, upper_comparison, difference, status):
    how often each feature is missing in either group, with Wilson intervals, all features in one pass."""
    some = df.filter(F.col(group).isin(reference, comparison))
    side = lambda g: F.col(group) == g
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).isNull().alias("gone")) for f in features])
    c = some.select(group, F.explode(rows).alias("x")).groupBy("x.feature").agg(
        F.count_if(side(reference)).alias("n_r"), F.count_if(side(comparison)).alias("n_c"), F.count_if(side(reference) & F.col("x.gone")).alias("k_r"), F.count_if(side(comparison) & F.col("x.gone")).alias("k_c")
    )
    (rl, ru), (cl, cu) = wilson("k_r", "n_r"), wilson("k_c", "n_c")
    return c.select(
        "feature", F.col("n_r").alias("n_reference"), F.col("n_c").alias("n_comparison"), q9(ratio("k_r", "n_r")).alias("rate_reference"), q9(ratio("k_c", "n_c")).alias("rate_comparison"),
        q9(rl).alias("lower_reference"), q9(ru).alias("upper_reference"), q9(cl).alias("lower_comparison"), q9(cu).alias("upper_comparison"), q9(ratio("k_c", "n_c") - ratio("k_r", "n_r")).alias("difference"),
        F.when(F.least("n_r", "n_c") == 0, "INCONCLUSIVE").when(F.least("n_r", "n_c") < minimum, "INSUFFICIENT_EVIDENCE").otherwise("DERIVED").alias("status"),
    )


def new_categories(df: DataFrame, group: str, reference: str, comparison: str, category: str, rare: float = 0.01) -> DataFrame:
    """(category, n, fraction, rare): categories of the comparison group that the reference group lacks."""
    c = df.filter(F.col(category).isNotNull()).groupBy(F.col(category).cast("string").alias("category")).agg(F.count_if(F.col(group) == reference).alias("x"), F.count_if(F.col(group) == comparison).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    found = c.filter("x = 0 and n > 0").crossJoin(F.broadcast(total))  # the total is one row
    return found.select("category", "n", q9(ratio("n", "total")).alias("fraction"), (ratio("n", "total") < rare).alias("rare"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level) of edges(src, dst): the longest way to a node from one that nothing leads to. Nodes on a cycle, and those behind one, have no level.

    Each round takes off the nodes whose sources are all gone, and counts down
    the rest's open edges: as many rounds as levels, each over the edges of the new nodes alone.
    """
    e = kept(edges.select("src", "dst").distinct())
    ends = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    open_ = kept(ends.join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open")), "node", "left").withColumn("open", F.coalesce("open", F.lit(0))))
    done, level = None, 0
    while True:
        now = kept(open_.filter("open = 0").select("node", F.lit(level).alias("level")))
        if now.isEmpty():
            rest = open_.select("node", F.lit(None).cast("int").alias("level"))
            return rest if done is None else done.unionByName(rest)
        done = now if done is None else done.unionByName(now)
        closed = e.join(now.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("closed"))
        open_ = open_.filter("open > 0").join(closed, "node", "left").select("node", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open"))
        open_, level = kept(open_), level + 1


def board(entries: DataFrame, entry: str, value: str, n: str, minimum: int, higher_is_better: bool = True) -> DataFrame:
    """(entry, value, n, rank, status): included entries with their place among equals (ties share the better one); excluded ones stay, with the reason."""
    ok = (F.col(n) >= minimum) & F.col(value).isNotNull()
    counts = entries.filter(ok).groupBy(value).agg(F.count("*").alias("c"))
    places = running(counts, [F.desc(value) if higher_is_better else F.asc(value)], {"better": F.col("c")}).select(value, (F.col("better") + 1).alias("rank"))
    out = entries.join(places, value, "left")
    status = F.when(F.col(value).isNull(), "EXCLUDED: no value").when(F.col(n) < minimum, "EXCLUDED: coverage").otherwise("INCLUDED")
    return out.select(entry, q9(value).alias(value), n, F.when(ok, F.col("rank")).alias("rank"), status.alias("status"))


def profile_join(a: DataFrame, b: DataFrame, key: str, value: str, status: str = "status") -> DataFrame:
    """(key, a, b, difference, relation): measures of two profiles matched by key. Only values that both state are subtracted."""
    x = a.select(key, F.col(value).alias("a"), F.col(status).alias("sa"))
    y = b.select(key, F.col(value).alias("b"), F.col(status).alias("sb"))
    both = x.join(y, key, "full")
    usable = (F.col("sa") == "COMPUTED") & (F.col("sb") == "COMPUTED")
    relation = F.when(F.col("sb").isNull(), "ONLY_IN_A").when(F.col("sa").isNull(), "ONLY_IN_B").when(~usable, "NOT_COMPARABLE").when(F.col("a") == F.col("b"), "EQUAL").otherwise("DIFFERENT")
    return both.select(key, q9("a").alias("a"), q9("b").alias("b"), q9(F.when(usable, F.col("b") - F.col("a"))).alias("difference"), relation.alias("relation"))


def criteria(measures: DataFrame, by: Sequence[str], least: dict[str, float]) -> DataFrame:
    """(by..., criterion, required, observed, passed, satisfied): each requirement of each cluster, and whether it meets them all."""
    checks = F.array(*[F.struct(F.lit(k).alias("criterion"), F.lit(float(v)).alias("required"), q9(F.col(k).cast("double")).alias("observed"), F.coalesce(F.col(k) >= v, F.lit(False)).alias("passed")) for k, v in least.items()])
    rows = measures.select(*by, checks.alias("c")).withColumn("satisfied", F.forall("c", lambda x: x["passed"]))
    return rows.select(*by, F.explode("c").alias("x"), "satisfied").select(*by, "x.criterion", "x.required", "x.observed", "x.passed", "satisfied")


def compactness(signals: DataFrame, cluster: str, features: Sequence[tuple[str, float]]) -> DataFrame:
    """(cluster, members, compactness): mean weighted share of equal features over a cluster's pairs, counted by value: no pair is listed. Null for one member."""
    size, weight = signals.groupBy(cluster).agg(F.count("*").alias("members")), sum(w for _, w in features)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(w)).alias("weight"), F.col(f).cast("string").alias("value")) for f, w in features])
    same = signals.select(cluster, F.explode(rows).alias("x")).groupBy(cluster, "x.feature", "x.weight", "x.value").agg(F.count("*").alias("c"))
    total = same.groupBy(cluster).agg(F.sum(F.col("weight") * F.col("c") * (F.col("c") - 1)).alias("s"))
    pairs = F.col("members") * (F.col("members") - 1)
    return size.join(total, cluster).select(cluster, "members", q9(F.try_divide(F.col("s"), pairs * weight)).alias("compactness"))


def perturbed(parameters: DataFrame, array: str, value: Column, changed: Column) -> DataFrame:
    """(array, n, max_abs_change, relative_l2_change) of perturbed parameters."""
    rows = parameters.select(F.col(array).alias("array"), value.alias("v"), (changed - value).alias("d"))
    a = rows.groupBy("array").agg(F.count("*").alias("n"), F.max(F.abs("d")).alias("m"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("v") * F.col("v")).alias("vv"))
    return a.select("array", "n", q9("m").alias("max_abs_change"), q9(F.when(F.col("vv") > 0, F.sqrt(F.try_divide("dd", "vv")))).alias("relative_l2_change"))


def scope_mask(df: DataFrame, key: str, kind: str, fraction: float = 1.0, seed: int = 0, label: object = None) -> DataFrame:
    """df with affected: ALL rows, the first round(fraction * n) rows by sha256(seed:key) (RANDOM_SUBSET), or those of one true label (CLASS)."""
    if kind == "ALL":
        return df.withColumn("affected", F.lit(True))
    if kind == "CLASS":
        return df.withColumn("affected", F.coalesce(F.col("y_true") == label, F.lit(False)))
    if kind != "RANDOM_SUBSET":
        raise ValueError("scope must be ALL, RANDOM_SUBSET or CLASS")
    from .calibration import hash_split

    return hash_split(df, key, fraction, seed).withColumn("affected", F.col("part") == "calibrate").drop("part")


def resource_summary(df: DataFrame, group: str, trial: str, seconds: str, reference: str) -> DataFrame:
    """(group, trials, throughput, cv, ratio, slower): each group's rows a second by trial, their variation, and the mean against the reference group's."""
    t = df.groupBy(group, trial).agg((F.count("*") / F.sum(seconds)).alias("r"))
    g = t.groupBy(group).agg(F.count("*").alias("trials"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))  # a row a group
    ref = g.filter(F.col(group) == reference).select(F.col("m").alias("base"))
    j = g.join(F.broadcast(ref), F.lit(True), "left")
    return j.select(group, "trials", q9("m").alias("throughput"), q9(F.when(F.col("trials") > 1, ratio("s", "m"))).alias("cv"), q9(ratio("m", "base")).alias("ratio"), (F.col("m") < F.col("base")).alias("slower"))


def top_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """df with rank: the k first rows of each group. Spark limits each task's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class Rule:
    """What makes a finding: a measure on one side of a threshold. comparison is '>', '>=' or '<'."""

    name: str
    severity: str
    measure: str
    comparison: str
    threshold: float


# The rules' names, severities, comparisons and usual thresholds.
RULES = (
    Rule("class-imbalance", "NOTICE", "imbalance_ratio", ">=", 3.0),
    Rule("minority-recall", "WARNING", "minority_recall", "<", 0.5),
    Rule("ece-threshold", "WARNING", "ece", ">", 0.10),
    Rule("high-confidence-errors", "WARNING", "high_confidence_error_rate", ">", 0.05),
    Rule("r2-floor", "WARNING", "r2", "<", 0.5),
    Rule("latency-outlier", "NOTICE", "latency_ratio", ">", 5.0),
    Rule("slice-accuracy-drop", "WARNING", "accuracy_drop", ">", 0.10),
    Rule("slice-accuracy-drop", "WARNING", "f1_drop", ">", 0.10),
    Rule("slice-error-increase", "WARNING", "mae_increase", ">", 0.25),
    Rule("slice-error-increase", "WARNING", "rmse_increase", ">", 0.25),
)


def with_thresholds(rules: Sequence[Rule], **thresholds: float) -> list[Rule]:
    """The rules with other thresholds, given by measure."""
    return [replace(r, threshold=thresholds.get(r.measure, r.threshold)) for r in rules]


def findings(measures: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(rule, severity, affected, measure, observed, comparison, threshold) of measures(affected, measure, value), one row for each rule that a value meets.

    Rules are a small stated list, not code: each row of measures is held against the rules of its measure. Values that are null or NaN, and measures without a rule, find nothing.
    """
    named = measures.filter("value is not null and not isnan(value)")
    hit = lambda r: {">": F.col("value") > r.threshold, ">=": F.col("value") >= r.threshold, "<": F.col("value") < r.threshold}[r.comparison]
    none = F.lit(None).cast("struct<rule:string,severity:string,comparison:string,threshold:double>")
    said = [F.when((F.col("measure") == r.measure) & hit(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.comparison).alias("comparison"), F.lit(float(r.threshold)).alias("threshold"))).otherwise(none) for r in rules]
    each = named.select("affected", "measure", "value", F.explode(F.array_compact(F.array(*said))).alias("r"))
    return each.select("r.rule", "r.severity", "affected", "measure", q9("value").alias("observed"), "r.comparison", "r.threshold")


def long_measures(df: DataFrame, affected: Column, **values: Column) -> DataFrame:
    """(affected, measure, value): a row for each value."""
    return df.select(affected.alias("affected"), F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in values.items()])))


def classification_measures(df: DataFrame, slices: str, sure: float = 0.9, bins: int = 10, minimum: int = 10) -> DataFrame:
    """(affected, measure, value) of a binary predictor df(y_true, y_pred, confidence, <slices>): what the findings' rules ask for.

    One pass: counts by class, prediction, bin and slice, of which all measures are sums. Slices of fewer than `minimum` rows have no
    drop. The minority is the class of fewest rows, of equal ones the least label; one class alone has neither imbalance nor minority.
    """
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    wrong = F.col("y_true") != F.col("y_pred")
    cells = kept(df.groupBy("y_true", "y_pred", b.alias("bin"), F.col(slices).alias("slice")).agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count_if(wrong & (F.col("confidence") >= sure)).alias("sure")))
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    classes = cells.groupBy("y_true").agg(F.sum("n").alias("n"), F.sum(hit).alias("k"))
    per_class = classes.agg(F.count("*").alias("classes"), ratio(F.max("n"), F.min("n")).alias("imbalance"), F.min_by(ratio("k", "n"), F.struct("n", "y_true")).alias("recall"), F.min_by("y_true", F.struct("n", "y_true")).alias("label"))
    several = F.col("classes") > 1
    out = long_measures(per_class, F.lit("overall"), imbalance_ratio=F.when(several, F.col("imbalance")))
    out = out.unionByName(long_measures(per_class, F.concat(F.lit("class:"), F.col("label").cast("string")), minority_recall=F.when(several, F.col("recall"))))
    by_bin = cells.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(hit).alias("k"), F.sum("c").alias("c"), F.sum("sure").alias("sure"))
    whole = by_bin.agg(ratio(F.sum(F.abs(F.col("k") - F.col("c"))), F.sum("n")).alias("ece"), ratio(F.sum("sure"), F.sum("n")).alias("sure"))
    out = out.unionByName(long_measures(whole, F.lit("overall"), ece=F.col("ece"), high_confidence_error_rate=F.col("sure")))
    count = lambda t, p: F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.col("n")).otherwise(0))
    f1 = ratio(2 * count(1, 1), 2 * count(1, 1) + count(0, 1) + count(1, 0))
    level = cells.groupingSets([("slice",), ()], "slice").agg(F.grouping("slice").alias("all"), F.sum("n").alias("n"), ratio(F.sum(hit), F.sum("n")).alias("accuracy"), f1.alias("f1"))
    base = level.filter("all = 1").select(F.col("accuracy").alias("a0"), F.col("f1").alias("f0"))
    each = level.filter(f"all = 0 and n >= {minimum}").crossJoin(F.broadcast(base))  # base is one row
    return out.unionByName(long_measures(each, F.concat(F.lit("slice:"), F.coalesce(F.col("slice").cast("string"), F.lit("null"))), accuracy_drop=F.col("a0") - F.col("accuracy"), f1_drop=F.col("f0") - F.col("f1")))


def regression_measures(df: DataFrame, slices: str, minimum: int = 10) -> DataFrame:
    """(affected, measure, value) of a regressor df(y_true, y_pred, <slices>): R² and each slice's relative increase of mean absolute error and root mean square over the whole. One pass."""
    e = F.col("y_pred") - F.col("y_true")
    level = df.groupingSets([(slices,), ()], slices).agg(F.grouping(slices).alias("all"), F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop("y_true").alias("var"))
    level = kept(level.withColumnRenamed(slices, "slice"))
    base = level.filter("all = 1")
    out = long_measures(base, F.lit("overall"), r2=1 - F.try_divide(F.col("mse"), F.col("var")))
    whole = base.select(F.col("mae").alias("a0"), F.sqrt("mse").alias("r0"))
    each = level.filter(f"all = 0 and n >= {minimum}").crossJoin(F.broadcast(whole))  # one row
    return out.unionByName(long_measures(each, F.concat(F.lit("slice:"), F.coalesce(F.col("slice").cast("string"), F.lit("null"))), mae_increase=ratio(F.col("mae") - F.col("a0"), "a0"), rmse_increase=ratio(F.sqrt("mse") - F.col("r0"), "r0")))


def latency_measures(df: DataFrame, value: str, minimum: int = 5) -> DataFrame:
    """(affected, measure, value): the slowest batch over the median one, with at least `minimum` batches and a median above 0."""
    a = beside(df.agg(F.max(value).alias("most")), quantiles(df, value, {"median": 0.5}))
    return long_measures(a, F.lit("overall"), latency_ratio=F.when((F.col("n") >= minimum) & (F.col("median") > 0), F.col("most") / F.col("median")))
