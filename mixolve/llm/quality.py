"""Quality classifier: a sparse ensemble of rules over text statistics, as Spark column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixolve.llm.common import carried, restored, scratch

#: Characters that prose seldom has (fixed values).
SYMBOLS = "!|%$&*#@^~<>{}[]\\/=+_`"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"
DIGITS = "0123456789"


def statistics(docs: DataFrame, *, text_col: str = "text", out: str = "_stats") -> DataFrame:
    """docs and a struct `out` of counts and ratios of the whole text, all from built-in functions.

    Null texts are empty. A column named like `out` is replaced. The struct passes through a
    generator, so that rules and filters on it don't compute it again for each mention.
    """
    keep = [c for c in docs.columns if c != out]
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    taken = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    times = lambda piece: (F.length("_t") - F.length(F.replace("_t", F.lit(piece), F.lit("")))) / len(piece)
    words = F.split("_t", " ")
    counts = F.struct(
        F.length("_t").cast("double").alias("chars"), F.size(words).cast("double").alias("words"), F.size(F.array_distinct(words)).cast("double").alias("distinct"),
        taken(SYMBOLS).alias("symbols"), taken(CAPITALS).alias("capitals"), taken(DIGITS).alias("digits"),
        times("|").alias("bars"), times("!").alias("shouts"), times(".").alias("stops"), times(",").alias("commas"), times("\n").alias("lines"),
    )
    counted = rows.select(*keep, F.explode(F.array(counts)).alias("_c"))
    c = lambda name: F.col(f"_c.{name}")
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    stats = F.struct(
        F.log1p(c("chars")).alias("log_chars"), F.log1p(c("words")).alias("log_words"), share("chars", "words").alias("word_length"), share("distinct", "words").alias("distinct_share"),
        *[share(n, "chars").alias(f"{n}_share") for n in ("symbols", "capitals", "digits", "bars", "shouts")], *[share(n, "words").alias(f"{n}_share") for n in ("stops", "commas", "lines")],
    )
    return counted.select(*keep, stats.alias(out))


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each feature an interval (above, up to]."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, within: str = "") -> Column:
        """The rule as a condition on columns, or on fields of the struct `within`."""
        out = F.lit(True)
        for name, low, high in self.bounds:
            value = F.col(f"{within}.{name}" if within else name)
            if low > float("-inf"):
                out = out & (value > low)
            if high < float("inf"):
                out = out & (value <= high)
        return out


@dataclass
class RuleEnsemble:
    """score = logistic(intercept + sum of the weights of the rules that hold)."""

    intercept: float = 0.0
    weights: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, within: str = "") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(within), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def paths(trees: list, names: list[str]) -> list[Rule]:
    """Every path from a root to a node of decision trees, as a rule; paths that say the same are one."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            found[Rule(tuple((n, *bounds[n]) for n in sorted(bounds)))] = None
        if node.subtreeDepth() == 0:
            return
        name, at = names[node.split().featureIndex()], node.split().threshold()
        low, high = bounds.get(name, (float("-inf"), float("inf")))
        walk(node.leftChild(), {**bounds, name: (low, min(high, at))})
        walk(node.rightChild(), {**bounds, name: (max(low, at), high)})

    for tree in trees:
        walk(tree.rootNode(), {})
    return list(found)


def fit(train: DataFrame, label: str = "label", *, trees: int = 20, depth: int = 3, bins: int = 64, penalty: float = 2e-3, rounds: int = 60, seed: int = 7) -> RuleEnsemble:
    """Grow trees on statistics, take their paths as rules, weigh the rules by lasso logistic regression.

    train: statistics and a label of 0.0 or 1.0. All its rows are used, by Spark's own distributed
    learners. Without rows of both labels the ensemble is the constant share of label 1 (0.5 if none).
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    names = [c for c in train.columns if c != label]
    n, ones = train.agg(F.count(label), F.coalesce(F.sum(label), F.lit(0.0))).first()
    if not n or ones in (0, n):
        share = (ones + 0.5) / (n + 1)
        return RuleEnsemble(math.log(share / (1 - share)))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(train).select(label, "features", *names).persist()
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, maxBins=bins, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed).fit(data)
    rules = paths([tree._java_obj for tree in forest.trees], names)
    flags = data.select(label, F.array(*[r.column().cast("double") for r in rules]).alias("flags"))
    flags = flags.select(label, array_to_vector("flags").alias("rules")).persist()
    lasso = LogisticRegression(labelCol=label, featuresCol="rules", elasticNetParam=1.0, regParam=penalty, maxIter=rounds, standardization=True).fit(flags)
    data.unpersist()
    flags.unpersist()
    return RuleEnsemble(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w])


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learn(stats: DataFrame, labels: DataFrame, *, id_col: str, label_col: str, **how) -> RuleEnsemble:
    """Fit on the rows of stats (id_col, _stats) that have a label and aren't held out.

    A document's label is the mean of its labels, 1 from one half on; null labels and IDs teach nothing.
    """
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_labelled")).agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    return fit(stats.where(~held_out(id_col)).join(marks, F.col(id_col) == F.col("_labelled")).select("label", "_stats.*"), **how)


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Learns only from labelled documents that aren't held out (crc32 of the ID as text, mod 5, not 0);
    only statistics of the text are inputs. Null and empty texts are scored like any; repeated rows
    each. Statistics are written once to the shared folder, so each text is read once.
    """
    stats = scratch(statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text"), "statistics")
    model = learn(stats, labels.withColumnRenamed(id_col, "doc_id"), id_col="doc_id", label_col=label_col, **how)
    return stats.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), model.score("_stats").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **how) -> DataFrame:
    """The rows of docs, all columns, whose score is at least threshold. Learns as score_documents does.

    Documents are written to the shared folder with their statistics, so these are counted once and
    only they, not the texts, meet the labels. Null and empty texts are scored like any; repeated
    rows each; columns of docs may have any name; an empty table stays empty.
    """
    rows = scratch(statistics(carried(docs, text_col, _id=id_col), text_col="_said"), "scored")
    model = learn(rows.select("_id", "_stats"), labels.withColumnRenamed(id_col, "_id"), id_col="_id", label_col=label_col, **how)
    return restored(rows.where(model.score("_stats") >= threshold), docs.columns, text_col)
