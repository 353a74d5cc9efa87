"""URL filtering: rule lists, and boosted trees over lexical features, all as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`text` is host and path prefix in one, split at the first slash."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_match(host: Column, path: Column, rules: list[Rule], value: str) -> Column:
    """`text` or `verdict` of the longest rule whose host is the url's or a parent of it and whose path starts the url's; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


#: Feature names in the order of the model's columns.
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "params", "hyphens", "host_labels", "suffix_rate", "file_ending")


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds x_<feature> columns (suffix_rate apart, which the model adds) from the host, path and url columns of `df`."""
    u, host, path = F.coalesce(df[url], F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.char_length(u), F.lit(1)).cast("double")
    count = lambda c, what: (F.char_length(c) - F.char_length(F.replace(c, F.lit(what), F.lit("")))).cast("double")
    entropy = F.aggregate(
        F.array_distinct(F.split(u, "")),
        F.lit(0.0),
        lambda a, c: a + F.when(c == "", 0.0).otherwise((F.char_length(u) - F.char_length(F.replace(u, c, F.lit("")))) / n * F.log2(n / (F.char_length(u) - F.char_length(F.replace(u, c, F.lit("")))))),
    )
    return df.withColumns(
        {
            "x_length": n,
            "x_host_length": F.char_length(host).cast("double"),
            "x_depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
            "x_digit_ratio": (F.char_length(u) - F.char_length(F.regexp_replace(u, "[0-9]", ""))) / n,
            "x_entropy": entropy,
            "x_params": count(F.coalesce(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), F.lit("")), "="),
            "x_hyphens": count(u, "-"),
            "x_host_labels": F.size(F.split(host, r"\.")).cast("double"),
            "x_file_ending": F.regexp_like(path, F.lit(r"\.[A-Za-z0-9]{1,5}$")).cast("double"),
            "suffix": F.regexp_extract(host, r"([^.]*(?:\.[^.]*)?)$", 1),
        }
    )


@dataclass
class Trees:
    """A boosted ensemble: base score, suffix rates, and per tree nested (feature, cut, left, right) or leaf values."""

    base: float = 0.0
    suffix: dict[str, float] = field(default_factory=dict)
    prior: float = 0.5
    trees: list = field(default_factory=list)

    def with_rate(self, df: DataFrame) -> DataFrame:
        rate = F.lit(self.prior)
        if self.suffix:
            rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(self.suffix.items()) for x in kv]), F.col("suffix")), rate)
        return df.withColumn("x_suffix_rate", rate)

    def score(self) -> Column:
        """Probability of `block` as one expression over the x_ columns."""

        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            k, cut, low, high = node
            return F.when(F.col(f"x_{FEATURES[k]}") <= F.lit(float(cut)), walk(low)).otherwise(walk(high))

        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + walk(t)
        return 1.0 / (1.0 + F.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0) -> tuple[float, list]:
    """Second-order gradient boosting of logistic loss over quantile-binned features."""
    if len(y) == 0:
        return 0.0, []
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return base, []
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)]  # bin b: cuts[b-1] < x <= cuts[b]
    f = np.full(len(y), base)

    def grow(rows: np.ndarray, left_depth: int):
        g, h = grad[rows], hess[rows]
        value = float(-rate * g.sum() / (h.sum() + 1))
        if not left_depth:
            f[rows] += value
            return value
        top = (1e-6, None, None)
        for k, c in enumerate(cuts):
            b = binned[k][rows]
            gl, hl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g, h))
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), -1)
            if len(gain) and gain.max() > top[0]:
                top = (gain.max(), k, int(gain.argmax()))
        if top[1] is None:
            f[rows] += value
            return value
        _, k, b = top
        low = binned[k][rows] <= b
        return k, float(cuts[k][b]), grow(rows[low], left_depth - 1), grow(rows[~low], left_depth - 1)

    trees = []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-f))
        grad, hess = prob - y, prob * (1 - prob)
        trees.append(grow(np.arange(len(y)), depth))
    return base, trees


def fit(labelled: DataFrame, url: str = "url", verdict: str = "label", bound: int = 20_000) -> Trees:
    """Trains on at most `bound` labelled urls (verdict `block` or `allow`), chosen by a hash of the url: a documented bound.

    Suffix rates are the share of `block` among the training urls of a host's last two labels, smoothed
    to the overall share; the 500 most frequent are kept in the model, the others use the share itself.
    """
    ready = lexical(labelled.filter(labelled[verdict].isin("block", "allow")).withColumn("host", host_of(labelled[url])).withColumn("path", path_of(labelled[url])), url)
    xs = [f"x_{n}" for n in FEATURES if n != "suffix_rate"]
    n = ready.count()
    if n > bound:  # else every task would send its own first `bound` rows to the driver
        ready = ready.filter(F.pmod(F.xxhash64(url), F.lit(1 << 40)) < F.lit(int((1 << 40) * 1.1 * bound / n)))
    rows = ready.select((F.col(verdict) == "block").cast("int").alias("y"), "suffix", *xs, F.xxhash64(url).alias("h")).orderBy("h", *xs, "y").limit(bound).drop("h").collect()
    if not rows:
        return Trees()
    y = np.array([r["y"] for r in rows], float)
    prior, sums = float(y.mean()), {}
    for r in rows:
        s = sums.setdefault(r["suffix"], [0, 0])
        s[0] += r["y"]
        s[1] += 1
    top = sorted(sums.items(), key=lambda kv: (-kv[1][1], kv[0]))[:500]
    model = Trees(suffix={k: (b + 5 * prior) / (n + 5) for k, (b, n) in top}, prior=prior)
    x = np.array([[model.suffix.get(r["suffix"], prior) if n == "suffix_rate" else r[f"x_{n}"] for n in FEATURES] for r in rows], float)
    model.base, model.trees = boost(x, y)
    return model


def judge(pages: DataFrame, rules: list[Rule], model: Trees, url: str = "url", id_col: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """One row for each row of `pages`: id, host, path, rule, verdict, score.

    The longest fitting rule decides; without one, a score of `threshold` or more blocks. Null urls and
    those without `://` have an empty host and path, fit no rule and are judged by the trees as an empty
    or odd url. Repeated rows give a row each, an empty table an empty result; columns of `pages` other
    than the two named are not read, so names cannot clash.
    """
    base = pages.select(pages[id_col].alias(id_col), pages[url].alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ready = model.with_rate(lexical(base))
    host, path = F.col("host"), F.col("path")
    scored = ready.withColumn("score", model.score()).withColumn("rule", rule_match(host, path, rules, "text"))
    verdict = F.coalesce(rule_match(host, path, rules, "verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
