"""Weak labelling of texts: rules as data, votes, their analysis, a label model, a text classifier, reports."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridecast.sources.shared import written

ABSTAIN, HEALTHY, PRODROMAL, RUPTURE = -1, 0, 1, 2


@dataclass(frozen=True)
class Rule:
    """Votes label where the lower-cased text matches one of the patterns, contains `must` and not `never`."""

    name: str
    label: int
    patterns: tuple[str, ...]
    must: str = ""
    never: str = ""

    def vote(self, text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        hit = F.lit(False)
        for p in self.patterns:
            hit = hit | F.rlike(low, F.lit(f"(?U){p}"))
        if self.must:
            hit = hit & F.contains(low, F.lit(self.must))
        if self.never:
            hit = hit & ~F.contains(low, F.lit(self.never))
        return F.when(hit, self.label).otherwise(ABSTAIN)


# The eight rules of the published labelling.
RULES = [
    Rule("rupture_explicit", RUPTURE, (r"ruptured?\s+achilles|achilles\s+ruptured?|torn\s+achilles|achilles\s+torn",)),
    Rule("rupture_season_ending", RUPTURE, (r"season.ending|out\s+for\s+the\s+season|career.threatening",), must="achilles"),
    Rule("prodromal_soreness", PRODROMAL, (r"achilles\s+(soreness|sore|tightness|tight|discomfort|pain|ache)", r"(soreness|sore|tightness|tight)\s+(in|of)\s+(his|her|the)\s+achilles")),
    Rule("prodromal_tendinopathy", PRODROMAL, (r"achilles\s+tendinit|tendinopathy|tendinosis|achilles\s+inflam",)),
    Rule("prodromal_load_management", PRODROMAL, (r"load\s+manag|rest\s+(day|ing)|dnp|did\s+not\s+play|questionable",), must="achilles"),
    Rule("healthy_no_injury", HEALTHY, (r"no\s+injury|cleared|full\s+practice|no\s+limitations|back\s+to\s+(normal|full)",), never="achilles"),
    Rule("healthy_activated", HEALTHY, (r"activated\s+from.*(il|injured\s+list)|returned?\s+to\s+(the\s+)?lineup",)),
    Rule("negative_context", HEALTHY, (r"no\s+achilles|achilles\s+(is\s+)?fine|achilles\s+cleared",)),
]


def votes(texts: DataFrame, text: str, rules: list[Rule] = RULES) -> DataFrame:
    """texts with votes: an array of one label a rule, -1 where it abstains."""
    return texts.withColumn("votes", F.array(*(r.vote(F.col(text)) for r in rules)))


def _other_than(own: Column):
    return lambda x: (x != ABSTAIN) & (x != own)


def rule_summary(voted: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """rule, polarity, coverage, overlap, conflict, from one pass over the votes."""
    v = F.col("votes")
    active = F.size(F.filter(v, lambda x: x != ABSTAIN))
    parts = []
    for i, r in enumerate(rules):
        own = F.get(v, F.lit(i))
        on = own != ABSTAIN
        against = F.exists(v, _other_than(own))
        share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
        parts.append(F.struct(F.lit(r.name).alias("rule"), F.sort_array(F.collect_set(F.when(on, own))).alias("polarity"), share(on).alias("coverage"), share(on & (active > 1)).alias("overlap"), share(on & against).alias("conflict")))
    return voted.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def hard_label(scores: Column, tolerance: float = 1e-9) -> Column:
    """The place of the largest score; ties and all-zero scores abstain."""
    top = F.array_max(scores)
    winners = F.filter(F.transform(scores, lambda x, i: F.when(x >= top - tolerance, i)), lambda x: x.isNotNull())
    return F.when((top > 0) & (F.size(winners) == 1), F.get(winners, F.lit(0))).otherwise(ABSTAIN)


def majority(voted: DataFrame, classes: int = 3) -> DataFrame:
    """voted with label: the class of most votes; a tie or no vote abstains."""
    count = lambda k: F.size(F.filter("votes", lambda x: x == k)).cast("double")
    counts = F.array(*(count(k) for k in range(classes)))
    return voted.withColumn("label", hard_label(counts))


@dataclass
class LabelModel:
    """balance: of the classes; hit[i, v] and miss[i, v]: how often rule i votes v where the class is v and where it isn't; accuracy[i]: the share
    of rule i's votes that are right. Rules vote independently of each other given whether the class is v."""

    balance: list[float]
    hit: dict[tuple[int, int], float]
    miss: dict[tuple[int, int], float]
    accuracy: dict[int, float]

    def weights(self, rules: int) -> Column:
        """An array of unnormalised class probabilities of a row's votes."""

        def weight(c: int) -> Column:
            logs = F.lit(math.log(self.balance[c]))
            for i in range(rules):
                said = F.get("votes", F.lit(i))
                for v in range(len(self.balance)):
                    if (i, v) in self.hit:
                        logs = logs + F.when(said == v, math.log((self.hit if v == c else self.miss)[i, v])).otherwise(0.0)
            return F.exp(logs)

        return F.array(*(weight(c) for c in range(len(self.balance))))


def fit_label_model(voted: DataFrame, classes: int = 3, balance: list[float] | None = None, accuracy: float = 0.7) -> LabelModel | None:
    """A label model from moments, without iterations; None without a vote.

    Whether rules i and j vote v has a covariance u_i u_j, as they err independently; so of three rules u_i^2 = C_ij C_ik / C_jk, and of all
    pairs by least squares the sum of C_ij C_ik C_jk over that of C_jk^2. With the balance of the classes (unless given,
    the shares of the majority's labels), u tells how often a rule votes v where that is right. A label that fewer than three rules
    vote for takes votes for other labels as evidence against it; where no three rules meet, votes are right with `accuracy`.
    Rows are counted by distinct votes once, written, and counted by pairs of votes; that table, of at most (rules * classes)^2
    rows, and sums by class reach the driver.
    """
    patterns = written(voted.groupBy("votes").agg(F.count("*").alias("n")))
    cast = F.filter(F.transform("votes", lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda x: x["v"] != ABSTAIN)
    pairs = patterns.select("n", F.explode(cast).alias("a"), cast.alias("b")).select("n", "a", F.explode("b").alias("b"))
    counts = {(r.i, r.v, r.j, r.w): r.n for r in pairs.groupBy(F.col("a.i").alias("i"), F.col("a.v").alias("v"), F.col("b.i").alias("j"), F.col("b.v").alias("w")).agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return None
    sums = majority(patterns, classes).groupBy("label").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in sums)
    by_label = {r.label: r.n for r in sums if r.label != ABSTAIN}
    balance = balance or [(by_label.get(c, 0) + 1) / (sum(by_label.values()) + classes) for c in range(classes)]
    single = {(i, v): n for (i, v, j, w), n in counts.items() if (i, v) == (j, w)}
    model = LabelModel(balance, {}, {}, {})
    for v in range(classes):
        # a rule's view of the label: the votes that speak for it or, where rules for it are few, against it
        views = {i: {v} for i, w in single if w == v}
        if len(views) < 3:
            for i, w in single:
                if (i, v) not in single:
                    views.setdefault(i, set()).add(w)
        mean = {i: sum(single[i, w] for w in ws) / total for i, ws in views.items()}
        covariance = {(i, j): sum(counts.get((i, x, j, y), 0) for x in views[i] for y in views[j]) / total - mean[i] * mean[j] for i in views for j in views if i != j}
        p = balance[v]
        for i in (i for i in views if views[i] == {v} and (i, v) in single):
            others = [j for j in views if j != i]
            three = [(covariance[i, j] * covariance[i, k] * covariance[j, k], covariance[j, k] ** 2) for j in others for k in others if j < k]
            top, bottom = sum(t for t, _ in three), sum(b for _, b in three)
            u = math.sqrt(top / bottom) if top > 0 and bottom > 0 else max(0.0, accuracy - p) * mean[i] / math.sqrt(p * (1 - p))
            hit = min(mean[i] + u * math.sqrt((1 - p) / p), 0.999, 0.999 * mean[i] / p)
            model.hit[i, v], model.miss[i, v] = hit, (mean[i] - p * hit) / (1 - p)
    for i in {i for i, _ in single}:
        right = sum(balance[v] * h for (r, v), h in model.hit.items() if r == i)
        model.accuracy[i] = right * total / sum(n for (r, v), n in single.items() if r == i)
    return model


def label_model(voted: DataFrame, classes: int = 3, balance: list[float] | None = None) -> DataFrame:
    """voted with probs (array, null where all rules abstain) and label, by fit_label_model; ties abstain. Votes outside the classes
    count as abstains."""
    known = voted.withColumn("votes", F.transform("votes", lambda x: F.when(x.between(0, classes - 1), x).otherwise(ABSTAIN)))
    model = fit_label_model(known, classes, balance)
    if model is None:
        return voted.withColumn("probs", F.lit(None).cast("array<double>")).withColumn("label", F.lit(ABSTAIN))
    rules = 1 + max(i for i, _ in model.hit)
    shares = F.get(F.transform(F.array(model.weights(rules)), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, y: a + y))), F.lit(0))
    some = F.exists("votes", lambda x: x.between(0, classes - 1))
    return voted.withColumn("probs", F.when(some, shares)).withColumn("label", F.when(some, hard_label(F.col("probs"))).otherwise(ABSTAIN))


def fit_text_classifier(labelled: DataFrame, text: str, label: str, features: int = 1 << 14):
    """Hashed TF-IDF and multinomial regression, on the rows that have a label (abstains go)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    rows = labelled.filter(F.col(label) >= 0).select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(label).cast("double").alias("_label"))
    steps = [RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_label", probabilityCol="_p", family="multinomial", maxIter=20, regParam=0.01)]
    return Pipeline(stages=steps).fit(rows)


def score_texts(model, texts: DataFrame, text: str) -> DataFrame:
    """texts with text_probs and text_score, the probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(texts.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    return scored.withColumn("text_probs", vector_to_array("_p")).select(*texts.columns, "text_probs", F.get("text_probs", F.lit(1)).alias("text_score"))


def classification_report(rows: DataFrame, label: str, predicted: str, classes: list[int]) -> DataFrame:
    """class, precision, recall, f1, support, and accuracy and macro_f1 on every row; what divides by zero is 0."""
    cells = rows.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    ratio = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    per = []
    for c in classes:
        hit, said, real = total((F.col("l") == c) & (F.col("p") == c)), total(F.col("p") == c), total(F.col("l") == c)
        per.append(F.struct(F.lit(c).alias("class"), ratio(hit, said).alias("precision"), ratio(hit, real).alias("recall"), ratio(2 * hit, said + real).alias("f1"), real.alias("support")))
    table = cells.agg(F.array(*per).alias("r"), ratio(total(F.col("l") == F.col("p")), total(F.lit(True))).alias("accuracy"))
    macro = F.aggregate("r", F.lit(0.0), lambda a, x: a + x["f1"]) / len(classes)
    return table.select(F.inline("r"), "accuracy", macro.alias("macro_f1"))
