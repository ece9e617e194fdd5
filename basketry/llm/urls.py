"""URL filters: rules found through their rarest literal token.

Each rule is a regular expression over ``host + path`` and carries the literal
tokens that every URL it fits must hold as whole tokens. One pass counts, over
all URLs, how many hold each of these tokens; a rule is filed under the one held
by fewest. In the second pass the tokens of a URL fetch the rules filed under
them, and only these run their regular expression, compiled when a task first
meets it. Rules without a literal token are always candidates.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, pinned

TOKEN = "[A-Za-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules sent to the tasks at once; larger sets are judged in that many at a time, one pass over the urls each.
SENT_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """``weight`` orders the rules that fit one URL; equal ones by action (block first), then name."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``.

    The last token of the path counts as literal only if a character that can't
    belong to it follows.
    """
    text = host + path
    tokens = tuple(m.group() for m in re.finditer(TOKEN, text) if m.end() < len(text))
    return Rule(text, action, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, len(text))


def word_rule(action: str, word: str) -> Rule:
    """Fits where ``word`` stands alone between other characters, in any place of host or path."""
    return Rule(word, action, rf"(?s:.*)(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", (word,), 0)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, host: str, path: str, tokens: Iterable[str]) -> dict[str, int]:
    """URLs that hold each of ``tokens``, over all of ``urls``; at most one row per token comes back."""
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    spark = urls.sparkSession
    known = spark.createDataFrame([(t,) for t in wanted], "token string")
    held = F.array_distinct(F.regexp_extract_all(F.concat(host, path), F.lit(f"({TOKEN})"), 1))
    found = urls.select(F.explode(held).alias("token")).join(F.broadcast(known), "token")
    counts = {r.token: r.n for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {t: counts.get(t, 0) for t in wanted}


def file_rules(rules: Iterable[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token, ties by token text; those without a token under the empty text."""
    index = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(index)


def judge_urls(df: DataFrame, rules: Iterable[Rule], url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` in place of any columns of these names.

    Of the rules that fit, the one of greatest weight decides (then block before
    allow, then the smaller name). Null urls and urls without ``://`` have empty
    host and path; no host rule fits them and the verdict is ``otherwise``.
    Rows are judged one by one: repeated rows, null ids and other columns stay.
    """
    rules = list(rules)
    parsed = df.drop("host", "path", "rule", "verdict")
    parsed = parsed.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    (judged,) = fresh(parsed, "judged")
    out = parsed.withColumn(judged, _decided(parsed, rules[:SENT_RULES]))
    for at in range(SENT_RULES, len(rules), SENT_RULES):
        out, _ = pinned(out, "judged")
        more = _decided(out, rules[at : at + SENT_RULES])
        out = out.withColumn(judged, F.least(judged, more))
    verdict = F.coalesce(F.col(f"{judged}.verdict"), F.lit(otherwise))
    return out.withColumns({"rule": F.col(f"{judged}.rule"), "verdict": verdict}).drop(judged)


def _decided(urls: DataFrame, rules: list[Rule]) -> Column:
    """The first of ``rules`` in the order in which they decide, as ``(order, other than block, rule, verdict)``; null: none fits."""
    filed = file_rules(rules, token_counts(urls, "host", "path", (t for r in rules for t in r.tokens)))

    @F.pandas_udf("order long, open boolean, rule string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokens, compiled = re.compile(TOKEN).findall, {}

        def fits(rule: Rule, text: str) -> bool:
            if rule not in compiled:
                compiled[rule] = re.compile(rule.pattern).match
            return compiled[rule](text) is not None

        for host, path in batches:
            out = []
            for text in host + path:
                fit = (r for t in {"", *tokens(text)} for r in filed.get(t, ()) if fits(r, text))
                out.append(min(((-r.weight, r.action != "block", r.name, r.action) for r in fit), default=(None,) * 4))
            yield pd.DataFrame(out, columns=["order", "open", "rule", "verdict"]).astype({"order": "Int64", "open": "boolean"})

    found = decide("host", "path")
    return F.when(found["rule"].isNotNull(), found)
