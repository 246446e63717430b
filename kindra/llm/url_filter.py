"""URL filters: rules by host and path, and a naive Bayes verdict on segmented host names for the rest.

Host names run words together. A label (what stands between dots and hyphens) is split by unigram Viterbi: words are the
labels and path parts that occur in the URLs, with their counts over all distinct hosts and all paths; a label's substrings
are joined with the word counts, so no word list is sent around. The tokens of a URL are the words of its host and of its
path. Multinomial naive Bayes over them carries the rules' verdicts to the pages that no rule fits: the pages that a rule
judges are its examples (``labels`` adds known hosts), without the labels and path parts that the rule itself names, as
those would only repeat the rule. Tokens are counted as they are, in a table, and distinct hosts and paths are joined with
the log ratios of their tokens; no table is sent around, and frequent keys are dealt out.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; empty
labels have no words; a page without host words, one whose tokens were never seen in an example, and any page where the
examples have one verdict alone is allowed unless a rule blocks it; equal scores allow; of equally likely splits the one
with the longer last word is taken; repeated pages are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindra.llm.common import Scratch, bounded_batches, shuffle_width

#: (host, path, verdict): fits the host and its subdomains where the path starts with the rule's; the longest wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Lengths of the words that segmentation knows; a label is segmented whole, whatever its length.
MIN_WORD, MAX_WORD = 3, 20
#: Shares of the rows, by shuffle partition, above which a host, path or token is dealt out.
HOT_PARTS = 4
#: Added to the count of every token that occurs.
SMOOTHING = 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CUT = r"[^\p{L}\p{N}]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_and_verdict(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path joined, and its verdict; nulls without one."""
    rule: Column | None = None
    verdict: Column | None = None
    for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def _labels(host: Column) -> Column:
    return F.filter(F.split(host, _CUT), lambda x: x != "")


def segment(length: int, words: list[tuple[int, int, int]], total: float) -> list[tuple[int, int]]:
    """Viterbi over (start, end, count): the likeliest split of 0:length. A stretch without known words costs much per
    character, so it is left in one piece. Ties go to the longer last word."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, end, count in words:
        ending.setdefault(end, []).append((start, math.log(count / total)))
    best, back = [0.0] + [-math.inf] * length, [0] * (length + 1)
    for end in range(1, length + 1):
        options = {end - 1: -math.log(total) - 12.0} | dict(ending.get(end, ()))
        for start in sorted(options):
            if best[start] + options[start] > best[end]:
                best[end], back[end] = best[start] + options[start], start
    spans, at = [], length
    while at > 0:
        spans.append((back[at], at))
        at = back[at]
    known = {(a, b) for a, b, _ in words}
    out: list[tuple[int, int]] = []
    for span in reversed(spans):
        if out and span not in known and (out[-1] not in known):
            out[-1] = (out[-1][0], span[1])
        else:
            out.append(span)
    return out


def segmented_labels(hosts: DataFrame) -> DataFrame:
    """(label, words) of every distinct host label of ``hosts`` (columns host, path)."""
    labels = hosts.select("host").distinct().select(F.explode(_labels(F.col("host"))).alias("w"))
    paths = hosts.select(F.explode(F.filter(F.split(F.translate("path", UPPER, LOWER), _CUT), lambda x: (F.length(x) >= MIN_WORD) & (F.length(x) <= MAX_WORD))).alias("w"))
    counts = labels.where((F.length("w") >= MIN_WORD) & (F.length("w") <= MAX_WORD)).unionByName(paths).groupBy("w").agg(F.count("*").alias("n"))
    counts = Scratch(counts, "url_words").keep()
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 1
    names = labels.distinct().withColumnRenamed("w", "label")
    spans = names.select("label", F.posexplode(F.sequence(F.lit(1), F.length("label"))).alias("p0", "start")).select(
        "label", "start", F.explode(F.sequence(F.col("start"), F.least(F.length("label"), F.col("start") + (MAX_WORD - 1)))).alias("stop")
    )
    pieces = spans.select("label", (F.col("start") - 1).alias("a"), F.col("stop").alias("b"), F.substr("label", F.col("start"), F.col("stop") - F.col("start") + 1).alias("w")).where(F.length("w") >= MIN_WORD)
    # A label is no evidence for itself: as one word it must occur elsewhere too.
    found = pieces.join(counts, "w").withColumn("n", F.col("n") - (F.col("w") == F.col("label")).cast("long")).where("n > 0").groupBy("label").agg(F.collect_list(F.struct("a", "b", "n")).alias("found"))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[x[a:b] for a, b in segment(len(x), [(r["a"], r["b"], r["n"]) for r in f] if f is not None else [], float(total))] for x, f in zip(label, found, strict=True)])

    return names.join(found, "label", "left").select("label", split("label", "found").alias("words"))


def _joined(rows: DataFrame, by: DataFrame, key: str, *other: str) -> DataFrame:
    """Left join on ``key``, of which ``by`` has each once. A key with more rows than 1 / HOT_PARTS of a partition's share is dealt to
    several places by the ``other`` columns; fewer than HOT_PARTS keys a partition can have that, and their places add up to
    less than twice as many, whatever the input."""
    parts = HOT_PARTS * shuffle_width(rows.sparkSession)
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = counts.where(F.col("n") * parts > total).select(key, F.ceil(F.col("n") * parts / max(total, 1)).cast("int").alias("places"))
    hot = F.broadcast(hot)
    dealt = rows.join(hot, key, "left").withColumn("place", F.pmod(F.xxhash64(*other), F.coalesce("places", F.lit(1))).cast("int")).drop("places")
    copied = by.join(hot, key, "left").withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1))).drop("places")
    return dealt.join(copied, [key, "place"], "left").drop("place")


def _named_parts(rule: Column) -> tuple[Column, Column]:
    """How many labels at a host's end and how many path parts a rule names; none without a rule."""
    labels, parts = F.lit(0), F.lit(0)
    for host, path, _ in RULES:
        labels = F.when(rule == host + path, len(re.findall(r"[^.-]+", host))).otherwise(labels)
        parts = F.when(rule == host + path, len(path_tokens(path))).otherwise(parts)
    return labels, parts


def path_tokens(path: str) -> list[str]:
    """Runs of letters, digits and underscores in lower case, but for plain numbers."""
    return [p for p in re.split(r"[^\w]+", path.lower()) if p and not p.isdigit()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _path_tokens(path: pd.Series) -> pd.Series:
    return pd.Series([["p:" + p for p in path_tokens(x)] for x in path])


def _token_weights(by_host: DataFrame, by_path: DataFrame, examples: DataFrame) -> tuple[DataFrame, float]:
    """(token, weight), the log ratio of each token that occurs in the examples, and that of the examples themselves.
    ``examples`` has n of each (host, path, rule, block), the parts that the rule names are left out."""
    labels, parts = _named_parts(F.col("rule"))
    pages = examples.withColumn("labels", labels).withColumn("parts", parts)
    host_tokens = F.flatten(F.transform(F.slice("placed", F.lit(1), F.greatest(F.size("placed") - F.col("labels"), F.lit(0))), lambda x: x["tokens"]))
    rest = F.slice("tokens", F.col("parts") + 1, F.greatest(F.size("tokens") - F.col("parts"), F.lit(0)))
    of_hosts = pages.groupBy("host", "labels", "block").agg(F.sum("n").alias("n")).join(by_host.select("host", "placed"), "host").select("block", "n", F.explode(host_tokens).alias("token"))
    of_paths = pages.groupBy("path", "parts", "block").agg(F.sum("n").alias("n")).join(by_path, "path").select("block", "n", F.explode(rest).alias("token"))
    own = lambda block: F.sum(F.when(F.col("block") == block, F.col("n")).otherwise(0))
    both = (own(False).alias("allow"), own(True).alias("block"))
    counts = Scratch(of_hosts.unionByName(of_paths).groupBy("token").agg(*both), "url_tokens").keep()
    n = counts.agg(F.count("*").alias("size"), F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    prior = pages.agg(*both).first()
    if not prior["block"] or not prior["allow"]:
        return counts.select("token", F.lit(0.0).alias("weight")), 0.0
    share = lambda c: (F.col(c) + SMOOTHING) / (n[c] + SMOOTHING * max(n["size"], 1))
    return counts.select("token", F.log(share("block") / share("allow")).alias("weight")), math.log(prior["block"] / prior["allow"])


def _weighed(by: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """(key, sum of the weights of its tokens); keys without known tokens are left out."""
    return _joined(by.select(key, F.explode("tokens").alias("token")), weights, "token", key).where("weight IS NOT NULL").groupBy(key).agg(F.sum("weight").alias(f"{key}_weight"))


def filter_urls(pages: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, host_words and method_verdict (what naive Bayes says, also where a rule decides)
    of every page. ``labels``: (host, block) of known hosts, each once; they join the examples where no rule judges."""
    host, path = host_and_path(F.col("url"))
    urls = Scratch(bounded_batches(pages).select("page_id", host.alias("host"), path.alias("path")), "urls").keep()
    # Words are joined to distinct hosts, not to pages: a host with many pages is one row here.
    words = segmented_labels(urls)
    hosts = urls.select("host").distinct()
    placed = hosts.select("host", F.posexplode(_labels(F.col("host"))).alias("i", "label")).join(words, "label")
    by_host = placed.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("i", "words", F.transform("words", lambda w: F.concat(F.lit("h:"), w)).alias("tokens")))).alias("placed"))
    flat = lambda c: F.flatten(F.transform("placed", lambda x: x[c])).alias(c)
    by_host = Scratch(by_host.select("host", "placed", flat("words"), flat("tokens")), "url_hosts").keep()
    by_path = Scratch(urls.select("path").distinct().withColumn("tokens", _path_tokens("path")), "url_paths").keep()
    # Distinct (host, path) with their numbers of pages.
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"))
    examples = urls.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("rule", rule).withColumn("block", verdict == "block")
    if labels is not None:
        known = labels.select("host", F.col("block").alias("known"))
        examples = _joined(examples, known, "host", "path").withColumn("block", F.coalesce("block", "known")).drop("known")
    examples = Scratch(examples.where("block IS NOT NULL"), "url_examples").keep()
    weights, bias = _token_weights(by_host, by_path, examples)
    hosts_weighed = by_host.select("host", "words").join(_weighed(by_host, "host", weights), "host", "left")
    rows = _joined(urls, hosts_weighed, "host", "page_id", "path")
    rows = _joined(rows, _weighed(by_path, "path", weights), "path", "page_id", "host")
    rows = rows.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    score = F.round(F.lit(bias) + F.coalesce("host_weight", F.lit(0.0)) + F.coalesce("path_weight", F.lit(0.0)), 9)
    seen = F.col("host_weight").isNotNull() | F.col("path_weight").isNotNull()
    judged = F.when((F.size("words") > 0) & seen & (score > 0), "block").otherwise("allow")
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), F.col("words").alias("host_words"), judged.alias("method_verdict"))
