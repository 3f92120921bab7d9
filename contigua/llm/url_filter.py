"""Operator 4: URL filters: rules first, then segmented words under multinomial naive Bayes.

Host labels and path parts are split at anything but letters. The runs of letters of all urls are counted, over distinct
hosts; they are the unigrams by which Viterbi splits run-together names into words. Naive Bayes learns what the rules
block against all other urls (which a blocklist leaves unlabelled), in words that the rules don't name themselves: every host
counts once, in parts, by the share of its pages that are blocked. Words that any blocklist has get a prior in log odds,
which is a parameter.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (action, host, path): fits the host and its subdomains where the url's path starts with path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: The prior: words of gambling, adult, drug-selling, advertising and fraud sites have PRIOR_ODDS beside what is learned.
PRIOR = tuple(
    "casino poker jackpot roulette slots betting bet bets bookmaker lottery porn xxx sex nude adult escort webcam viagra cialis pills pharma replica "
    "warez keygen torrent malware phishing spam seo adserver ads banner popup tracker payday loans".split()
)
PRIOR_ODDS = 6.0
#: A url without rule is blocked where the odds are more than three to one: pages that no rule blocks aren't all wanted.
LEAST_ODDS = math.log(3)
#: A word has at least this share of all counts: at most 200,000 are, whatever the input.
LEAST_SHARE = 1 / 200_000
#: Longer runs are split like any other, but are no words.
LONGEST = 40
#: A task tells its counts each time that it holds so many; shares of a host are counted in millionths.
FLUSH, WHOLE = 200_000, 1_000_000


class UrlModel:
    """Words with counts (blocked, other) of hosts that have them, and the number of hosts of either kind."""

    SMOOTHING = 0.5
    #: An unknown letter costs as if every one of so many were as likely.
    LETTERS = 30.0
    #: Next to unknown letters, a shorter word is chance; nor is a name split into shorter ones.
    SURE, SHORTEST = 4, 3

    def __init__(self, runs: dict[str, int]) -> None:
        """runs: the counts of the runs that are words; those that others make up are taken out."""
        total = sum(runs.values())
        self.longest = max(map(len, runs), default=0)
        self.unknown = (-math.log(total or 1), -math.log(self.LETTERS))
        self.word = {w: math.log(n / total) for w, n in runs.items() if n > 0 and not self._made_up(w, runs)}
        self.weight: dict[str, float] = {}
        self.prior = 0.0
        self.segment = lru_cache(1 << 15)(self._segment)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "segment"}

    def __setstate__(self, state: dict) -> None:
        """A task has a cache of segmented runs of its own."""
        self.__dict__.update(state)
        self.segment = lru_cache(1 << 15)(self._segment)

    def _made_up(self, run: str, runs: dict[str, int]) -> bool:
        """Whether the run splits wholly into other words, each of SHORTEST letters and in as many hosts."""
        least, n = self.SHORTEST, len(run)
        ends = {0}
        for end in range(least, n + 1):
            if any(end - begin < n and runs.get(run[begin:end], 0) >= runs[run] for begin in ends if end - begin >= least):
                ends.add(end)
        return n in ends and n >= 2 * least

    def learn(self, counts: dict[str, tuple[float, float]], blocked: float, other: float, named: frozenset[str] = frozenset(), prior: tuple[str, ...] = ()) -> None:
        """Naive Bayes from each word's counts in blocked and other hosts; words that the rules name are no evidence."""
        counts = dict.fromkeys(prior, (0, 0)) | counts
        own = {w: c for w, c in counts.items() if w in self.word and w not in named}
        s, sums = self.SMOOTHING, [sum(c[k] for c in own.values()) for k in (0, 1)]
        of = lambda c, k: math.log((c[k] + s) / (sums[k] + s * max(len(own), 1)))
        self.weight = {w: of(c, 0) - of(c, 1) + PRIOR_ODDS * (w in prior) for w, c in own.items()}
        self.prior = math.log((blocked + 1) / (other + 1))

    def _segment(self, run: str) -> tuple[str, ...]:
        """Words of a run of letters, most likely first to last; unknown stretches are in brackets."""
        best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
        fixed, each = self.unknown
        for end in range(1, len(run) + 1):
            found = (-math.inf, 0, False)
            for begin in range(max(0, end - self.longest), end):
                if (p := self.word.get(run[begin:end])) is not None and (q := best[begin][0] + p) > found[0]:
                    found = (q, begin, True)
            # An unknown stretch grows by a letter, or begins here.
            score, begin, known = best[end - 1]
            if not known and end > 1 and score + each > found[0]:
                found = (score + each, begin, False)
            elif (q := score + fixed + each) > found[0]:
                found = (q, end - 1, False)
            best.append(found)
        out, end = [], len(run)
        while end:
            _, begin, known = best[end]
            out.append(run[begin:end] if known else f"[{run[begin:end]}]")
            end = begin
        return tuple(out[::-1])

    def words(self, run: str) -> list[str]:
        """Words of evidence of a run. One that isn't wholly made of known words counts only for its words of SURE letters."""
        found = (self.segment if len(run) <= 64 else self._segment)(run)
        whole = not any(w[0] == "[" for w in found)
        return [w for w in found if w[0] != "[" and (whole or len(w) >= self.SURE)]

    def odds(self, host: str, path: str) -> float:
        """Log odds of being blocked: those of all hosts where nothing is known of the words."""
        return self.prior + sum(self.weight.get(w, 0.0) for run in runs_of(host, path) for w in self.words(run))


def runs_of(host: str, path: str) -> list[str]:
    """Runs of the letters a to z; whatever else stands in a host or path parts them."""
    return re.findall("[a-z]+", host) + re.findall("[a-z]+", path.lower())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): see the contract. Only A-Z are lower-cased."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host = rest[: end.start()] if end else rest
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


class RuleSet:
    """The longest rule (host and path together) that fits; equal lengths go by the host's, then by order."""

    def __init__(self, rules) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for action, host, path in rules:
            self.by_host.setdefault(host, []).append((path, action))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        found, at = None, 0
        while host and at >= 0:
            name = host[at:]
            for start, action in self.by_host.get(name, ()):
                if path.startswith(start) and (found is None or len(name) + len(start) > len(found[0])):
                    found = (name + start, action)
            at = host.find(".", at) + 1 or -1
        return found


def fit(pages: DataFrame, *, rules=RULES, prior: tuple[str, ...] = PRIOR, url_col: str = "url") -> UrlModel:
    """The model of a table of urls: unigrams of all hosts and paths, naive Bayes of what the rules block and the rest.

    Every host counts once for each of its runs, so that one with a third of all pages weighs as any other. The driver
    gets the words (LEAST_SHARE) and their counts, a row each, and no more. Words of the prior count as seen once.
    """

    def to_runs(batches):
        table, held = RuleSet(rules), {}

        def told():
            columns = zip(*((run, host, *n) for (run, host), n in held.items()), strict=True)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("run", "host", "blocked", "pages"), columns, kinds, strict=True)})

        for batch in batches:
            for url in batch.column(0).to_pylist():
                host, path = split_url(url)
                if not host:
                    continue
                rule = table.find(host, path)
                # The empty run stands for the host itself.
                for run in {"", *runs_of(host, path)}:
                    n = held.setdefault((run, host), [0, 0])
                    n[0] += rule is not None and rule[1] == "block"
                    n[1] += 1
                if len(held) >= FLUSH:
                    yield told()
                    held = {}
        if held:
            yield told()

    seen = pages.select(F.col(url_col).cast("string")).mapInArrow(to_runs, "run string, host string, blocked long, pages long")
    hosts = seen.groupBy("run", "host").agg((F.sum("blocked") * WHOLE / F.sum("pages")).cast("long").alias("part"))
    counts = hosts.groupBy("run").agg(F.sum("part").alias("blocked"), F.count("*").alias("n"))
    counts = materialise(counts, "url-runs")
    of_hosts = counts.where("run = ''").first()
    counts = counts.where("run <> ''")
    total = counts.agg(F.sum("n")).first()[0] or 0
    runs = dict.fromkeys(prior, 1) | {r.run: r.n for r in counts.where((F.col("n") >= LEAST_SHARE * total) & (F.length("run") <= LONGEST)).select("run", "n").collect()}
    model = UrlModel(runs)

    def to_words(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for run, blocked, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for w in model.words(run):
                    for column, x in zip(out, (w, blocked, n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_pydict({"word": pa.array(out[0], pa.string()), "blocked": pa.array(out[1], pa.int64()), "n": pa.array(out[2], pa.int64())})

    found = counts.select("run", "blocked", "n").mapInArrow(to_words, "word string, blocked long, n long")
    found = found.groupBy("word").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n"))
    split = lambda r: (r.blocked / WHOLE, r.n - r.blocked / WHOLE)
    named = frozenset(run for _, host, path in rules for run in runs_of(host, path))
    model.learn({r.word: split(r) for r in found.collect()}, *(split(of_hosts) if of_hosts else (0, 0)), named, prior)
    return model


def judge(pages: DataFrame, *, rules=RULES, prior=PRIOR, model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, odds) of every row.

    verdict is the rule's, else block where the model's log odds are above LEAST_ODDS. Null, empty and schemeless urls have empty
    host and path, no rule, and are allowed. Repeated rows are judged alike, an empty table gives no rows, urls of any
    length are read whole; only the two columns are read. Without a model, one is fitted to the pages.
    """
    model = fit(pages, rules=rules, prior=prior, url_col=url_col) if model is None else model

    def run(batches):
        table = RuleSet(rules)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = table.find(host, path)
                score = model.odds(host, path) if host or path else 0.0
                verdict = rule[1] if rule else "block" if score > LEAST_ODDS else "allow"
                for col, x in zip(cols, (host, path, rule and rule[0], verdict, score), strict=True):
                    col.append(x)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0)} | {n: pa.array(c, k) for n, c, k in zip(("host", "path", "rule", "verdict", "odds"), cols, kinds, strict=True)})

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string"))
    return chosen.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, odds double")
