"""Grid search over text features, strengths and kernels of top-down classifiers."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.codes import LEVELS
from tillroll.operators import kernels, linear
from tillroll.operators.bayes import Edges
from tillroll.operators.classify import tree_edges
from tillroll.operators.evaluate import weighted_scores
from tillroll.operators.split import with_fold
from tillroll.session import stage

# Kernels that take a gamma.
WITH_GAMMA = ("rbf", "sigmoid")
# Kernels without a feature map, by their loss.
LOSS_OF = {"linear": "squared_hinge", "logistic": "logistic"}

RESULT = T.StructType(
    [
        T.StructField("max_df", T.DoubleType()),
        T.StructField("ngram_low", T.IntegerType()),
        T.StructField("ngram_high", T.IntegerType()),
        T.StructField("c", T.DoubleType()),
        T.StructField("kernel", T.StringType()),
        T.StructField("gamma", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("reason", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Setting:
    max_df: float
    ngram_low: int
    ngram_high: int
    c: float
    kernel: str
    gamma: float | None

    def problem(self) -> str | None:
        """Why it cannot be fitted."""
        if self.kernel not in LOSS_OF and self.kernel not in kernels.KERNELS:
            return f"no classifier for kernel {self.kernel}"
        if not self.c > 0 or self.kernel in WITH_GAMMA and not (self.gamma or 0) > 0:
            return "c and gamma have to be positive"
        return None


def settings(
    max_dfs: Sequence[float],
    ngram_ranges: Sequence[tuple[int, int]],
    cs: Sequence[float],
    kernels: Sequence[str],
    gammas: Sequence[float],
) -> list[Setting]:
    """The product of all choices; gamma varies only for kernels that have one."""
    return [
        Setting(float(max_df), low, high, float(c), kernel, gamma)
        for max_df, (low, high), c, kernel in itertools.product(max_dfs, ngram_ranges, cs, kernels)
        for gamma in (gammas if kernel in WITH_GAMMA else [None])
    ]


def _spec(setting: Setting, model: int, split: int) -> linear.Spec:
    terms = (model, split, setting.ngram_low, setting.ngram_high, setting.max_df, setting.c)
    if setting.kernel in LOSS_OF:
        return linear.Spec(*terms, LOSS_OF[setting.kernel])
    return kernels.KernelSpec(*terms, kernel=setting.kernel, gamma=float(setting.gamma))


def _predicted(docs: DataFrame, specs: Sequence[linear.Spec], edges: Edges, rounds: int, width: int) -> DataFrame:
    """(model, true, pred, n) over the rows that each model's split holds back."""
    dense = [s for s in specs if isinstance(s, kernels.KernelSpec)]
    plain = [s for s in specs if not isinstance(s, kernels.KernelSpec)]
    steps = []
    if plain:
        weights = linear.fit(docs, plain, edges, rounds)
        steps.append((plain, lambda at: linear.predict(at, weights)))
    if dense:
        maps = kernels.fit(docs, dense, edges, width, rounds)
        steps.append((dense, lambda at: kernels.predict(at, maps)))
    out = None
    for some, step in steps:
        asked = [F.struct(F.lit(s.model).alias("model"), F.get("held", F.lit(s.split)).alias("n")) for s in some]
        held = docs.select("code", "id", F.inline(F.array(*asked))).where("n > 0")
        paths = linear.descend(held.select("model", "id").distinct(), len(LEVELS), step)
        pairs = held.join(paths, ["model", "id"]).groupBy("model", F.col("code").alias("true"), "pred")
        pairs = pairs.agg(F.sum("n").alias("n"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def grid_search(
    df: DataFrame,
    choices: Sequence[Setting],
    code: str,
    label: str,
    key: str = "ROW_ID",
    k: int = 5,
    method: str = "hash",
    max_iter: int = 10,
    width: int = kernels.WIDTH,
) -> DataFrame:
    """(setting, f1, reason): mean weighted F1 of the predicted codes over `k` folds, best first.

    A setting that cannot be fitted comes last, with a null score and the reason; so does one without rows.

    Rows are counted per code and text once, with the number in each fold; what a fold trains on is the total
    minus its own. All settings and folds without a feature map are fitted and scored together, and so are all
    those with one. Only the scores reach the driver.
    """
    fitted = [(i, s) for i, s in enumerate(choices) if s.problem() is None]
    rows = with_fold(df.where(F.col(code).isNotNull() & F.col(label).isNotNull()), k, key, method)
    docs = linear.count_texts(rows, code, label, [F.col("fold") == f for f in range(1, k + 1)])
    specs = [_spec(s, i * k + split, split) for i, s in fitted for split in range(k)]
    scores = {}
    if specs:
        pairs = stage(_predicted(docs, specs, tree_edges, max_iter, width), "pairs")
        by_model = weighted_scores(pairs, ["model"])
        means = by_model.groupBy(F.floor(F.col("model") / k).alias("setting")).agg(F.round(F.avg("f1"), 6).alias("f1"))
        scores = {r["setting"]: r["f1"] for r in means.collect()}
    table = [
        (s.max_df, s.ngram_low, s.ngram_high, s.c, s.kernel, s.gamma, scores.get(i), s.problem() or (None if i in scores else "no rows"))
        for i, s in enumerate(choices)
    ]
    table.sort(key=lambda r: (r[-2] is None, -(r[-2] or 0.0)))
    return df.sparkSession.createDataFrame(table, RESULT)


def linear_classifier(
    train: DataFrame, test: DataFrame, code: str, label: str, setting: Setting, order_col: str = "ROW_ID", max_iter: int = 10
) -> DataFrame:
    """`linear.linear_classifier` with the choices of a setting without a feature map."""
    if setting.kernel not in LOSS_OF:
        raise ValueError(f"{setting.kernel} needs a feature map")
    ngram, loss = (setting.ngram_low, setting.ngram_high), LOSS_OF[setting.kernel]
    return linear.linear_classifier(train, test, code, label, order_col, ngram, setting.max_df, setting.c, loss, max_iter)


def best_setting(results: DataFrame) -> DataFrame:
    """The fitted setting with the highest score; of equals the one whose choices sort first."""
    choices = [c for c in results.columns if c not in ("f1", "reason")]
    fitted = results.where(F.col("f1").isNotNull())
    return fitted.orderBy(F.desc("f1"), *choices).limit(1)
