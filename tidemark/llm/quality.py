"""Quality rules as weak supervision: rules vote, expectation-maximisation weighs them. DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, cut

GOOD, BAD, ABSTAIN = 1, -1, 0
#: Words of letters and digits with their combining marks, a mark of words or numbers within and one mark at each end at most.
PLAIN = rf"""(?<![^{SPACE}])[("']?[\p{{L}}\p{{M}}\p{{N}}]++(?:['’.,:‌‍-][\p{{L}}\p{{M}}\p{{N}}]++)*+[.,;:!?।)"'%]?(?![^{SPACE}])"""


def text_features(text: Column) -> dict[str, Column]:
    """Counts of one text, as a chain of columns: each may use those before it, so add them one at a time.

    Everything stays within the row, so nothing is shuffled. Repeated 3-word windows are found by sorting
    64-bit window hashes; only texts with a repeat sort their positions too.
    """
    c = F.col
    hashes = F.transform(F.sequence(F.lit(1), c("q_n_words") - 2), lambda i: F.xxhash64(F.element_at(c("q_words"), i), F.element_at(c("q_words"), i + 1), F.element_at(c("q_words"), i + 2)))
    placed = F.sort_array(F.transform(c("q_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twin(x: Column, i: Column) -> Column:
        return (F.get(c("q_placed"), i - 1)["h"] == x["h"]) | (F.get(c("q_placed"), i + 1)["h"] == x["h"])

    covered = F.flatten(F.transform(F.filter(c("q_placed"), lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return {
        "q_text": F.coalesce(text, F.lit("")),
        "q_words": F.filter(F.split(c("q_text"), f"[{SPACE}]+"), lambda w: w != ""),
        "q_n_words": F.size("q_words"),
        "q_chars": F.length(F.array_join("q_words", "")).cast("long"),
        "q_symbols": (F.length("q_text") - F.length(F.regexp_replace("q_text", r"[#*$%&|<>]+", ""))).cast("long"),
        "q_upper": (F.length("q_text") - F.length(F.regexp_replace("q_text", r"[A-Z]+", ""))).cast("long"),
        "q_plain": F.regexp_count("q_text", F.lit(PLAIN)),
        "q_lines": F.filter(F.split(c("q_text"), "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        "q_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_windows": F.when(c("q_n_words") >= 3, hashes).otherwise(F.array().cast("array<bigint>")),
        "q_placed": F.when(F.size(F.array_distinct("q_windows")) < F.size("q_windows"), placed),
        "q_repeat_words": F.when(c("q_placed").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """A rule votes bad where `bad` holds, else good where `good` holds, else it abstains. Nulls don't hold."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.bad, BAD).when(self.good, GOOD).otherwise(ABSTAIN)


def default_rules() -> list[Rule]:
    """Rules over the columns of text_features(); every share is a share of the words, lines or characters of a text."""
    n, c = F.greatest(F.col("q_n_words"), F.lit(1)), F.col
    symbols, repeats = c("q_symbols") / n, c("q_repeat_words") / n
    dup = c("q_dup_lines") / F.greatest(F.size("q_lines"), F.lit(1))
    mean, upper = c("q_chars") / n, c("q_upper") / F.greatest(c("q_chars"), F.lit(1))
    return [
        Rule("length", c("q_n_words") >= 80, c("q_n_words") < 20),
        Rule("word_length", mean.between(3.5, 7.0), (mean < 2.5) | (mean > 12.0)),
        Rule("symbols", symbols <= 0.02, symbols > 0.2),
        Rule("plain_words", c("q_plain") / n >= 0.75, c("q_plain") / n < 0.6),
        Rule("duplicate_lines", dup <= 0.05, dup > 0.4),
        Rule("repeated_windows", repeats <= 0.1, repeats > 0.4),
        Rule("capitals", upper <= 0.08, upper > 0.35),
    ]


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and for each rule the chances of its votes on good and on bad documents."""

    prior: float
    given_good: tuple[dict[int, float], ...]
    given_bad: tuple[dict[int, float], ...]

    def log_odds(self, votes: Sequence[Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, g, b in zip(votes, self.given_good, self.given_bad, strict=True):
            total = total + F.when(v == GOOD, math.log(g[GOOD] / b[GOOD])).when(v == BAD, math.log(g[BAD] / b[BAD])).otherwise(0.0)
        return total

    def posterior(self, votes: Sequence[Column]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(votes)))


def fit(patterns: Sequence[tuple[Sequence[int], int]], n_rules: int, rounds: int = 100, prior: float = 0.9, sensitivity: float = 0.98, specificity: float = 0.3) -> LabelModel:
    """Expectation-maximisation over (votes, number of documents).

    There are at most 3 ** n_rules patterns whatever the size of the corpus, so this runs on the driver; they are taken
    in order, so that reruns agree in every bit.
    An abstention says nothing. A rule votes good on most good documents (a share that starts at `sensitivity`
    and stays between 0.9 and 0.995, a range so narrow that it is rather given than learned: rules that fail many good documents are not worth having) and bad on some bad ones (`specificity`, 0.05 to 0.95, as each rule
    knows one kind of bad document only). These ranges tell the classes apart, so they can't change places; the
    prior stays between 0.5 and 0.98. A few pseudo-documents keep rare votes from deciding.
    """
    clip = lambda x, lo, hi: min(hi, max(lo, x))
    sens, spec = [sensitivity] * n_rules, [specificity] * n_rules
    patterns = sorted((tuple(votes), count) for votes, count in patterns)
    for _ in range(rounds):
        hits = [[2 * sensitivity, 2.0, 2 * specificity, 2.0] for _ in range(n_rules)]
        good = total = 0.0
        for votes, count in patterns:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(votes):
                if v == GOOD:
                    odds += math.log(sens[j] / (1 - spec[j]))
                elif v == BAD:
                    odds += math.log((1 - sens[j]) / spec[j])
            p = 1 / (1 + math.exp(-clip(odds, -500, 500)))
            good, total = good + p * count, total + count
            for j, v in enumerate(votes):
                if v != ABSTAIN:
                    hits[j][0] += p * count * (v == GOOD)
                    hits[j][1] += p * count
                    hits[j][2] += (1 - p) * count * (v == BAD)
                    hits[j][3] += (1 - p) * count
        sens = [clip(h[0] / h[1], 0.9, 0.995) for h in hits]
        spec = [clip(h[2] / h[3], 0.05, 0.95) for h in hits]
        prior = clip(good / total if total else prior, 0.5, 0.98)
    return LabelModel(prior, tuple({GOOD: s, BAD: 1 - s} for s in sens), tuple({GOOD: 1 - s, BAD: s} for s in spec))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of docs in a struct `row`, with the columns of text_features() beside it."""
    out = docs.select(F.struct("*").alias("row"), F.col(text).alias("q_in"))
    for name, column in text_features(F.col("q_in")).items():
        out = out.withColumn(name, column)
    return out.drop("q_in")


def votes_of(rules: Sequence[Rule]) -> Column:
    return F.array(*[r.vote().cast("int") for r in rules])


def learn(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> LabelModel:
    """The label model of a corpus: counts its vote patterns, over all documents, and fits them."""
    rules = default_rules() if rules is None else rules
    counts = with_features(docs, text).select(votes_of(rules).alias("v")).groupBy("v").count()
    return fit([(r["v"], r["count"]) for r in counts.collect()], len(rules))


def base_failed() -> Column:
    """The two hard limits that no vote can outweigh."""
    return (F.col("q_n_words") < 50) | (100 * F.col("q_repeat_words") > 50 * F.col("q_n_words"))


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns of docs but for the text, with counts, q_posterior (chance that the document is good), q_base_failed and q_kept.

    Null text counts as empty: no words, so base-failed. A corpus without documents gives no rows. Repeated
    rows get equal verdicts; long texts are taken whole, within their row; null ids stay null. A document is kept if it passes the base limits and q_posterior >= threshold.
    Each text is gone through once; its counts and votes are written to the shared folder. Columns of docs
    that have the name of a result are replaced by it.
    """
    rules = default_rules() if rules is None else rules
    counts = ["q_n_words", "q_chars", "q_symbols", "q_dup_lines", "q_repeat_words"]
    made = {*counts, "q_base_failed", "q_votes", "q_posterior", "q_kept"}
    keep = [c for c in docs.columns if c != text and c not in made]
    base = cut(with_features(docs, text).select(*[F.col("row")[c].alias(c) for c in keep], *counts, base_failed().alias("q_base_failed"), votes_of(rules).alias("q_votes")))
    patterns = base.groupBy("q_votes").count().collect()
    model = fit([(r["q_votes"], r["count"]) for r in patterns], len(rules))
    posterior = model.posterior([F.col("q_votes")[j] for j in range(len(rules))])
    return base.withColumn("q_posterior", posterior).withColumn("q_kept", ~F.col("q_base_failed") & (posterior >= threshold))


def kept_rows(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() would keep, all columns as they are.

    Each text is gone through twice, once for the votes' counts and once to decide, so that no text is
    written or shuffled.
    """
    rules = default_rules() if rules is None else rules
    votes = [r.vote() for r in rules]
    posterior = learn(docs, rules, text).posterior(votes)
    kept = (~base_failed() & (posterior >= threshold)).alias("q_kept")
    # the row number keeps the optimizer from moving the condition below the features, where it would compute each of them over and over
    judged = with_features(docs, text).select("row", kept, F.monotonically_increasing_id().alias("q_at"))
    return judged.where("q_kept and q_at >= 0").select("row.*")
