"""URL filter: rules for hosts and paths first, then a word model of what is left.

Host names are mostly words run together. A unigram model, the counts of the words in the pages' own texts, splits each label of a host
by Viterbi's algorithm into its likeliest words; a multinomial naive Bayes model over the words of host and path, learnt from the pages
that the rules decide, then judges the pages that they don't.

Hosts are never grouped, so a host with a third of all pages costs no more than others; each worker keeps the splits it has made in a bounded dictionary. The
word counts and the class counts are aggregated over all pages before anything is shuffled, and stay whole, totals included, in written tables. The model holds those that
can be asked for: counts of words that stand in some distinct label of a host, and class counts of words of pages that no rule decides. Neither is capped, so driver and
workers need memory for the distinct words of all hosts and of the undecided pages' paths.

Defined cases: a null url or one without "://" has an empty host and path, which no rule fits; with no words to go by the classes'
shares decide, a tie is allowed; if the rules decide no page, everything else is allowed; rows are judged one by one, so repeated rows
are judged alike; a very long label is split in time in proportion to its length; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LONGEST_WORD = 24
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
Rule = tuple[str, str, str]


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWERED), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


class Rules:
    """The longest rule that fits a host and path: host and all subdomains, path by its beginning. Of equal length the one with the longer host, then the one that blocks."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict)"""
        best = None
        at = host
        while True:
            for start, verdict in self.by_host.get(at, ()):
                if path.startswith(start) and (best is None or (len(at) + len(start), len(at), verdict) > best[0]):
                    best = (len(at) + len(start), len(at), verdict), at + start
            dot = at.find(".")
            if dot < 0:
                return best and (best[1], best[0][2])
            at = at[dot + 1 :]


@dataclass
class WordModel:
    """Unigram counts and, by class, counts of words. totals (by class) and distinct are those of the whole class table; None: words is the whole table."""

    counts: dict[str, int]
    total: int
    classes: dict[str, int] = field(default_factory=dict)
    words: dict[str, dict[str, int]] = field(default_factory=dict)
    totals: dict[str, int] | None = None
    distinct: int | None = None

    def __post_init__(self):
        self.log_total = math.log(max(1, self.total))
        self.cost = {w: self.log_total - math.log(n) for w, n in self.counts.items()}
        self.known: dict[str, list[str]] = {}
        totals = self.totals if self.totals is not None else {c: sum(by.values()) for c, by in self.words.items()}
        distinct = self.distinct if self.distinct is not None else len({w for by in self.words.values() for w in by})
        self.shares = {c: math.log(n / sum(self.classes.values())) for c, n in self.classes.items()}
        self.rows = {c: (self.words.get(c, {}), math.log(totals.get(c, 0) + distinct + 1)) for c in self.classes}

    def split(self, label: str) -> list[str]:
        """The likeliest words of a label. A stretch of n characters that is no word costs as much as one of once in ten words' tenth for each character."""
        if (words := self.known.get(label)) is not None:
            return words
        best, back = [0.0], [0]
        for end in range(1, len(label) + 1):
            cost, begin = min((best[b] + self.cost.get(label[b:end], self.log_total + (end - b) * math.log(10)), b) for b in range(max(0, end - LONGEST_WORD), end))
            best.append(cost)
            back.append(begin)
        words, end = [], len(label)
        while end:
            words.append(label[back[end] : end])
            end = back[end]
        words.reverse()
        if len(label) <= 64:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[label] = words
        return words

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of host labels and of the path, apart from each other; every number is one token."""
        out = []
        for label in re.split(r"[.\-_:@]+", host):
            for run in re.findall(r"\d+|\D+", label):
                out += ["h:0"] if run.isdecimal() else ["h:" + w for w in self.split(run)]
        for run in re.findall(r"\d+|[^\W\d_]+", path.lower()):
            out.append("p:0" if run[0].isdecimal() else "p:" + run)
        return out

    def score(self, host: str, path: str) -> float:
        """Log odds of block against allow, with add-one smoothing."""
        if set(self.classes) != {"allow", "block"}:
            return 1.0 if set(self.classes) == {"block"} else -1.0
        odds = self.shares["block"] - self.shares["allow"]
        (block, block_total), (allow, allow_total) = self.rows["block"], self.rows["allow"]
        for t in self.tokens(host, path):
            odds += math.log(block.get(t, 0) + 1) - block_total - math.log(allow.get(t, 0) + 1) + allow_total
        return odds


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """word, n: the runs of letters in a column of html, tags left out, lower-cased, up to LONGEST_WORD characters."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "<[^>]*>", " "))
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word"))
    return words.filter((F.length("word") > 0) & (F.length("word") <= LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def fit_words(pages: DataFrame, html: str = "html", url: str = "url") -> WordModel:
    """The counts of all words of the pages; held are those of words that stand in a label of some host."""
    counts = written(word_counts(pages, html), "word-counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    hosts = pages.select(parts_of(F.col(url))[0].alias("host")).distinct()
    runs = hosts.select(F.explode(F.split("host", r"[.\-_:@\d]+")).alias("run")).filter("run != ''").distinct()
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    stretches = starts.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("run") - F.col("start") + 1)), lambda n: F.col("run").substr(F.col("start"), n))).alias("word"))
    found = counts.join(stretches.distinct(), "word", "left_semi")
    return WordModel({r["word"]: r["n"] for r in found.toLocalIterator()}, total)


def _tokenised(shared, rules: list[Rule]):
    def run(batches):
        model, table = shared.value, Rules(rules)
        for batch in batches:
            verdicts, words = [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                hit = table.find(host, path)
                verdicts.append(hit and hit[1])
                words.append(model.tokens(host, path))
            yield pa.RecordBatch.from_arrays([pa.array(verdicts, pa.string()), pa.array(words, pa.list_(pa.string()))], ["verdict", "words"])

    return run


def fit_classes(pages: DataFrame, model: WordModel, rules: list[Rule], url: str = "url") -> WordModel:
    """The model with class counts from every page that the rules decide; held are those of words of the other pages."""
    host, path = parts_of(F.col(url))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    judged = pages.select(host.alias("host"), path.alias("path")).mapInArrow(_tokenised(shared, rules), "verdict string, words array<string>")
    # one pass: a page's own entry is the null word; words without a verdict are those that will be asked for
    words = judged.select("verdict", F.explode(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("word")).groupBy("verdict", "word").agg(F.count("*").alias("n"))
    words = written(words, "class-counts")
    decided = words.filter("verdict is not null")
    classes = {r["verdict"]: r["n"] for r in decided.filter("word is null").collect()}
    totals = {r["verdict"]: r["n"] for r in decided.filter("word is not null").groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    distinct = decided.filter("word is not null").select("word").distinct().count()
    by: dict[str, dict[str, int]] = {}
    for r in decided.join(words.filter("verdict is null and word is not null").select("word"), "word", "left_semi").toLocalIterator():
        by.setdefault(r["verdict"], {})[r["word"]] = r["n"]
    return WordModel(model.counts, model.total, classes, by, totals, distinct)


def judge_urls(pages: DataFrame, model: WordModel, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (log odds of block, null where a rule decides), words (the host's and path's tokens)."""
    host, path = parts_of(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held, table = shared.value, Rules(rules)
        for batch in batches:
            found, verdicts, scores, words = [], [], [], []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                hit = table.find(h, p)
                score = None if hit else held.score(h, p)
                found.append(hit and hit[0])
                verdicts.append(hit[1] if hit else "block" if score > 0 else "allow")
                scores.append(score)
                words.append(held.tokens(h, p))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(found, pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64()), pa.array(words, pa.list_(pa.string()))],
                ["page_id", "host", "path", "rule", "verdict", "score", "words"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double, words array<string>")
