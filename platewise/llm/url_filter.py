"""URL filters: host rules, and pattern rules indexed by their rarest token.

Host rules name a host and a path prefix; the longest that fits decides.  The
other URLs are judged by pattern rules (regular expressions).  A pattern's
parse tree tells which literal tokens any URL that it matches must contain;
where it has alternatives, each has its own.  The rule is filed under the
token of each alternative that is rarest among the URLs.  A URL is cut into
tokens, its tokens fetch the rules filed under them, and only those rules run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre, _parser as sre_parser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class HostRule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """Blocks URLs that match ``pattern`` (searched in the lower-cased URL)."""
    name: str
    pattern: str


# The host rules of the production query.
HOST_RULES = (
    HostRule("allow", "com", "/"), HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"), HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"))

# Parameter: unwanted hosts and paths of the production query.
PATTERN_RULES = (
    PatternRule("gambling", r"://([^/?#]*[.-])?casino[.-]win([.-]|[/?#:]|$)"),
    PatternRule("betting", r"://([^/?#]*[.-])?free-bets?[.-]"),
    PatternRule("pharmacy", r"://([^/?#]*[.-])?cheap-pills[.-]"),
    PatternRule("ad_host", r"://([^/?#]*[.-])?ads-track[.-]"),
    PatternRule("ad_server", r"://ads?\d*\."),
    PatternRule("login", r"/(wp-)?login\.php([?#]|$)"),
    PatternRule("cart", r"/(cart|checkout)/(add|pay)([/?#]|$)"),
    PatternRule("archive_file", r"\.(zip|rar|exe|iso)([?#]|$)"),
)

#: Tokens are runs of letters and runs of digits.
TOKEN = "[a-z]+|[0-9]+"
#: Alternatives of a pattern that are told apart; what has more counts as unknown text.
MOST_WAYS = 256

#: What a pattern may match, item by item: a letter or digit itself, or one of these.
UNKNOWN, GAP, DIGITS, LETTERS = "unknown", "gap", "digits", "letters"


def _kind(item: str) -> str:
    return item if len(item) > 1 else LETTERS if item.isalpha() else DIGITS


def _set_kind(members) -> str:
    """What a character class can be: digits, neither letter nor digit, or unknown."""
    kinds = set()
    for op, value in members:
        if op is sre.LITERAL:
            c = chr(value)
            kinds.add(DIGITS if c in "0123456789" else UNKNOWN if c.isalnum() or value > 127 else GAP)
        elif op is sre.CATEGORY and value is sre.CATEGORY_DIGIT:
            kinds.add(DIGITS)  # other scripts' digits are no tokens, nor parts of one
        elif op is sre.CATEGORY and value is sre.CATEGORY_SPACE:
            kinds.add(GAP)
        else:
            kinds.add(UNKNOWN)
    return kinds.pop() if len(kinds) == 1 else UNKNOWN


def ways(tree) -> list[tuple[str, ...]]:
    """The ways in which a parsed pattern matches, as sequences of items."""
    out: list[tuple[str, ...]] = [()]
    for op, value in tree:
        if op is sre.LITERAL:
            c = chr(value)
            step = [(c if c.isascii() and c.isalnum() else UNKNOWN if value > 127 else GAP,)]
        elif op is sre.IN:
            step = [(_set_kind(value),)]
        elif op is sre.AT:
            step = [(GAP,)] if value in (sre.AT_END, sre.AT_END_STRING, sre.AT_BEGINNING, sre.AT_BEGINNING_STRING) \
                else [()]
        elif op is sre.SUBPATTERN:
            step = ways(value[3])
        elif op is sre.BRANCH:
            step = [w for branch in value[1] for w in ways(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            once = ways(inner)
            many = once if once in ([(DIGITS,)], [(GAP,)]) else [(UNKNOWN,)]  # digits in a row are one run
            step = ([()] if not least else []) + (once if most == 1 else many)
        else:
            step = [(UNKNOWN,)]
        out = [a + b for a in out for b in step]
        if len(out) > MOST_WAYS:
            out = [(UNKNOWN,)]
    return list(dict.fromkeys(out))


def required_tokens(pattern: str) -> list[frozenset[str]]:
    """For each way in which the pattern matches, the tokens that a URL then
    has for certain: literal runs with a known end on both sides."""
    if re.compile(pattern).flags & re.IGNORECASE:
        return [frozenset()]
    found = []
    for way in ways(sre_parser.parse(pattern)):
        items, tokens = (UNKNOWN, *way, UNKNOWN), set()
        i = 1
        while i < len(items) - 1:
            if len(items[i]) > 1:
                i += 1
                continue
            kind, j = _kind(items[i]), i
            while len(items[j]) == 1 and _kind(items[j]) == kind:
                j += 1
            if not {_kind(items[i - 1]), _kind(items[j])} & {UNKNOWN, kind}:
                tokens.add("".join(items[i:j]))
            i = j
        found.append(frozenset(tokens))
    return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased) and path (then up to ``?``, ``#`` or the end)."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (m[1].encode().lower().decode(), m[2]) if m else ("", "")


def host_index(rules: tuple[HostRule, ...]) -> dict[str, list[HostRule]]:
    index: dict[str, list[HostRule]] = {}
    for r in rules:
        index.setdefault(r.host, []).append(r)
    return index


def find_host_rule(index: dict[str, list[HostRule]], host: str, path: str) -> HostRule | None:
    """The longest fitting rule by its name's length; of two, the longer host's."""
    labels = host.split(".")
    fitting = [r for k in range(len(labels)) for r in index.get(".".join(labels[k:]), ())
               if path.startswith(r.path)]
    return max(fitting, key=lambda r: (len(r.name), len(r.host)), default=None) if host else None


def token_counts(urls: DataFrame, url_col: str, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs, over all rows; one
    row for each token of the rules comes to the driver."""
    if not tokens:
        return {}
    lists = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit(f"({TOKEN})")))
    rows = (urls.select(F.explode(lists).alias("token")).where(F.col("token").isin(*sorted(tokens)))
            .groupBy("token").count().collect())
    return {r["token"]: r["count"] for r in rows}


def pattern_index(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> dict[str | None, list]:
    """Rules by the rarest token of each of their ways; those with a way
    without a certain token under None, where every URL runs them."""
    index: dict[str | None, list] = {}
    for r in rules:
        rarest = {min(tokens, key=lambda t: (counts.get(t, 0), t), default=None)
                  for tokens in required_tokens(r.pattern)}
        for token in [None] if None in rarest else sorted(rarest):
            index.setdefault(token, []).append((r.name, re.compile(r.pattern)))
    return index


def judge(urls: DataFrame, id_col: str = "page_id", url_col: str = "url",
          host_rules: tuple[HostRule, ...] = HOST_RULES,
          pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """Per row: page_id, host, path, rule (the host rule that decided, or
    null), pattern (the first pattern rule in the given order that matches,
    judged where no host rule decides, else null) and verdict.

    A null URL or one without ``://`` has empty host and path, and is judged
    by the pattern rules like any other; nothing matches a null URL, so it is
    allowed.  Rows that repeat are judged one by one.
    """
    counts = token_counts(urls, url_col, {t for r in pattern_rules for w in required_tokens(r.pattern) for t in w})
    hosts, patterns = host_index(host_rules), pattern_index(pattern_rules, counts)
    place = {r.name: k for k, r in enumerate(pattern_rules)}
    tokens_of = re.compile(TOKEN).findall

    def find_pattern(url: str | None) -> str | None:
        low = (url or "").lower()
        rules = dict([x for t in (None, *dict.fromkeys(tokens_of(low))) for x in patterns.get(t, ())])
        return min((name for name, rx in rules.items() if rx.search(low)), key=place.get, default=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                rule = find_host_rule(hosts, host, path)
                pattern = None if rule else find_pattern(url)
                out.append((host, path, rule and rule.name, pattern,
                            rule.verdict if rule else "block" if pattern else "allow"))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)],
                                             names=["page_id", "host", "path", "rule", "pattern", "verdict"])

    return (urls.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
            .mapInArrow(run, "page_id long, host string, path string, rule string, pattern string, "
                             "verdict string"))
