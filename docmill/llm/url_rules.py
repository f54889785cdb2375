"""URL filters: pattern rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

#: Rules are a table that an operator writes by hand; beyond this many they should be a DataFrame of their own.
MOST_RULES = 100_000
_TOKEN = re.compile(r"[0-9a-z]+")
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    """A regular expression over `host + path`, with A-Z lower-cased first where fold is set; literals are lower-case
    tokens that every URL it fits contains, lower-cased."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int
    fold: bool = False

    @classmethod
    def site(cls, verdict: str, name: str) -> Rule:
        """`host/path`: the host and all its subdomains, where the path starts with the rule's; longer names win."""
        host, slash, path = name.partition("/")
        whole = [*_TOKEN.findall(lowered(host)), *_TOKEN.findall(lowered(path))[: None if path.endswith("/") else -1]]
        return cls(name, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(whole), 1_000_000 + len(name))

    @classmethod
    def word(cls, verdict: str, word: str) -> Rule:
        """A word, in either case, anywhere in host or path, between characters that aren't letters or digits; any site
        rule wins over it, then the longer word, then a block."""
        word = lowered(word)
        return cls("", verdict, rf"(?:^|[^0-9a-z]){re.escape(word)}(?![0-9a-z])", tuple(_TOKEN.findall(word)), len(word), True)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(text: str) -> str:
    """A-Z to a-z, nothing else."""
    return text.translate(_LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty where there is no `://`. A-Z of the host are lower-cased, nothing else is changed."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return lowered(m[1]), m[2]


class RuleIndex:
    """Rules by their rarest literal: the one that fewest rules have, then the longest. Rules without one always run."""

    def __init__(self, rules: list[Rule]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be indexed")
        seen = Counter(t for r in rules for t in set(r.literals))
        self.always: list[Rule] = []
        self.by_token: dict[str, list[Rule]] = {}
        for r in rules:
            if r.literals:
                self.by_token.setdefault(min(r.literals, key=lambda t: (seen[t], -len(t), t)), []).append(r)
            else:
                self.always.append(r)
        self.compiled: dict[str, re.Pattern] = {}

    def fits(self, rule: Rule, text: str, folded: str) -> bool:
        if (p := self.compiled.get(rule.pattern)) is None:
            p = self.compiled[rule.pattern] = re.compile(rule.pattern)
        return p.search(folded if rule.fold else text) is not None

    def best(self, host: str, path: str) -> Rule | None:
        """The rule of highest rank that fits; of equal ones a block, then the one of greatest name and pattern."""
        text, folded = host + path, host + lowered(path)
        tried = [*self.always, *(r for t in set(_TOKEN.findall(folded)) for r in self.by_token.get(t, ()))]
        return max((r for r in tried if self.fits(r, text, folded)), key=lambda r: (r.rank, r.verdict == "block", r.name, r.pattern), default=None)


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (the name of the site rule that decided, else null), verdict.

    A URL's tokens fetch the rules indexed under them, and only those run their regular expressions. The rule of highest
    rank decides; without any the verdict is `default`. Nothing is shuffled and only id and url are read.

    Null URLs and URLs without `://`: host and path empty, no rule, default. Repeated rows and null ids: judged each on
    its own. Empty table: no rows.
    """
    index = RuleIndex(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                r = index.best(host, path)
                out.append((host, path, (r.name or None) if r else None, r.verdict if r else default))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"])

    return pick(pages, page_id=id_col, url=url_col).mapInArrow(run, SCHEMA)
