"""URL filters: rules indexed by their rarest literal token.

A rule is a host and a path prefix; it fits that host and its subdomains.  Its literal tokens are the labels of its
host and the whole segments of its path (the last one, unless a `/` ends it, may go on in a url and is no token).
Each rule is filed under the token that the fewest urls hold, counted over the whole table (ties: the fewest rules,
then the token's order).  A url looks its own tokens up; only the rules found there run their regular expression.

Defined cases: a null url, or one without `://`, has an empty host and path and gets the default verdict; repeated urls
are judged one by one; an empty table gives an empty result; other columns are passed through untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import lower_ascii

_PARTS = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"\A(?:[^/]*\.)?{re.escape(self.host)}(?=/|\Z){re.escape(self.path)}"


def parse_rule(line: str) -> Rule:
    """`allow host/path` or `block host/path`."""
    verdict, _, rest = line.strip().partition(" ")
    host, slash, path = rest.strip().partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {line!r}")
    return Rule(verdict, lower_ascii(host), slash + path)


def split_url(url: str | None) -> tuple[str, str]:
    found = _PARTS.match(url) if url else None
    return (lower_ascii(found[1]), found[2]) if found else ("", "")


def tokens(host: str, path: str, whole: bool) -> set[str]:
    """Host labels `h:x` and path segments `p:x`; whole: the last segment is complete."""
    parts = path.split("/")[1:]
    return {f"h:{x}" for x in host.split(".") if x} | {f"p:{x}" for x in (parts if whole else parts[:-1]) if x}


class RuleIndex:
    """Rules by their rarest token.  Its size is that of the rule list, which the caller gives as a Python list."""

    def __init__(self, rules: list[Rule], url_counts: dict[str, int]):
        among_rules = Counter(t for r in rules for t in tokens(r.host, r.path, False))
        # longest first; of equally long ones the first in the list wins
        self.rules = sorted(rules, key=lambda r: -len(r.name))
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, r in enumerate(self.rules):
            own = tokens(r.host, r.path, False)
            if own:
                rarest = min(own, key=lambda t: (url_counts.get(t, 0), among_rules[t], t))
                self.by_token.setdefault(rarest, []).append(i)
            else:
                self.always.append(i)

    def compiled(self) -> list[re.Pattern]:
        return [re.compile(r.pattern) for r in self.rules]

    def candidates(self, host: str, path: str) -> list[int]:
        """Rule numbers to try, longest rule first."""
        found = set(self.always)
        for t in tokens(host, path, True):
            found.update(self.by_token.get(t, ()))
        return sorted(found)


def _token_counts(urls: DataFrame, url_col: str, wanted: set[str]) -> dict[str, int]:
    """How many urls hold each wanted token; counted over all urls, at most len(wanted) rows to the driver."""
    known = urls.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                seen.update(tokens(*split_url(url), True) & known.value)
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = urls.select(url_col).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, tried) for every row; rule is null where none fits, tried counts expressions run."""
    wanted = {t for r in rules for t in tokens(r.host, r.path, False)}
    index = pages.sparkSession.sparkContext.broadcast(RuleIndex(rules, _token_counts(pages, url_col, wanted)))
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    schema = f"id {dict(out.dtypes)['id']}, host string, path string, rule string, verdict string, tried int"

    def judge(batches):
        own = index.value
        patterns = own.compiled()
        for batch in batches:
            hosts, paths, names, verdicts, tried = [], [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                subject, name, verdict, n = host + path, None, default, 0
                for i in own.candidates(host, path):
                    n += 1
                    if patterns[i].match(subject):
                        name, verdict = own.rules[i].name, own.rules[i].verdict
                        break
                hosts.append(host), paths.append(path), names.append(name), verdicts.append(verdict), tried.append(n)
            text = lambda x: pa.array(x, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text(hosts), text(paths), text(names), text(verdicts), pa.array(tried, pa.int32())], ["id", "host", "path", "rule", "verdict", "tried"])

    return out.mapInArrow(judge, schema).withColumnRenamed("id", id_col)
