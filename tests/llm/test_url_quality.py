import math

from contigua.llm import quality, url_filter

from .conftest import prose


def test_split_url():
    assert url_filter.split_url("HTTPS://WWW.Example.COM/En/x?y#z") == ("www.example.com", "/En/x")
    assert url_filter.split_url("a://b?c/d") == ("b", "")
    assert url_filter.split_url("a://b#c/d") == ("b", "")
    assert url_filter.split_url("no scheme") == ("", "") == url_filter.split_url(None) == url_filter.split_url("")
    assert url_filter.split_url("x://Ä.com/a://b") == ("Ä.com", "/a://b")


def test_rules_by_brute_force():
    rules = url_filter.RuleSet(url_filter.RULES)
    for host in ("com", "example.com", "www.example.com", "a.www.example.com", "badexample.com", "x.net", "net", "org", ""):
        for path in ("/", "/en/", "/en/x", "/es/1", "/fr/", "/de/", "", "en/"):
            fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            want = max(fits)[1:] if fits else None
            assert rules.find(host, path) == want


def test_segmentation():
    m = url_filter.UrlModel({"casino": 3, "win": 5, "free": 9, "software": 2, "casinowin": 2, "example": 20, "and": 4, "therand": 1})
    assert m.segment("casinowin") == ("casino", "win")  # as often seen apart: no word of its own
    assert m.segment("freesoftware") == ("free", "software")
    assert m.words("thxqcasinozzq") == ["casino"]
    assert m.words("thandser") == []
    assert m.segment("") == ()
    m.learn({"casino": (3, 0), "software": (0, 2), "example": (9, 0)}, 3, 9, frozenset(["example"]))
    assert m.odds("casinowin.example.org", "/en/1") > 0 > m.odds("freesoftware.example.org", "/en/1")
    assert math.isclose(m.odds("example.example", ""), math.log(4 / 10))


def best_split(m, run):
    """All splits into known words and single unknown stretches, scored one by one."""
    best = (-math.inf, None)
    n = len(run)
    for cuts in range(1 << (n - 1)):
        parts, at = [], 0
        for i in range(1, n):
            if cuts >> (i - 1) & 1:
                parts.append(run[at:i])
                at = i
        parts.append(run[at:])
        score = sum(m.word[p] if p in m.word else m.unknown[0] + len(p) * m.unknown[1] for p in parts)
        best = max(best, (score, [p if p in m.word else f"[{p}]" for p in parts]))
    return best


def test_viterbi_finds_the_best_split():
    m = url_filter.UrlModel({"ab": 2, "abc": 1, "cd": 1, "b": 1, "d": 1, "abcd": 1})
    score = lambda parts: sum(m.word[p] if p[0] != "[" else m.unknown[0] + (len(p) - 2) * m.unknown[1] for p in parts)
    for run in ("abcd", "abxcd", "xxab", "abcdabc", "zzz", "bdbd"):
        assert math.isclose(score(list(m.segment(run))), best_split(m, run)[0])


BAD, GOOD = "darts wager stake odds punter croupier".split(), "garden museum recipe poetry weather library".split()


def named_urls(hosts, n_each=1):
    """(page_id, url): run-together names under bad.net, which a rule blocks, good.net and, undecided, other.org."""
    return [(i, f"http://{name}.{site}/{'x' * (i % 3)}{i}") for i, (name, site) in enumerate(h for h in hosts for _ in range(n_each))]


RULED = (("block", "bad.net", "/"), ("allow", "good.net", "/"))


def split_names():
    """Names as three words each; in the decided hosts they are parted by hyphens, in the others run together."""
    import itertools

    decided = [("-".join(p), "bad.net") for p in itertools.permutations(BAD, 2)] + [("-".join(p), "good.net") for p in itertools.permutations(GOOD, 2)]
    unseen = [("".join(p), "other.org") for p in itertools.permutations(BAD, 3)] + [("".join(p), "other.org") for p in itertools.permutations(GOOD, 3)]
    return decided, unseen


def test_names_that_no_rule_decides(spark):
    """Held-out accuracy on run-together names of words that are learned from decided hosts; without any prior list."""
    decided, unseen = split_names()
    model = url_filter.fit(spark.createDataFrame(named_urls(decided), "page_id long, url string"), rules=RULED, prior=())
    table = spark.createDataFrame(named_urls(unseen), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(table, rules=RULED, model=model).collect()}
    right = sum((got[i].verdict == "block") == (name.startswith(tuple(BAD))) for i, (name, _) in enumerate(unseen))
    assert right >= 0.95 * len(unseen)


def model_by_brute_force(rows, rules, prior):
    """Counts in plain Python, host by host."""
    pages = {}
    for _, url in rows:
        host, path = url_filter.split_url(url)
        fits = [(len(h + p), a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        for run in {"", *url_filter.runs_of(host, path)}:
            pages.setdefault((run, host), []).append(bool(fits) and max(fits)[1] == "block")
    runs = {}
    for (run, _), flags in pages.items():
        share = sum(flags) / len(flags)
        held = runs.setdefault(run, [0.0, 0.0])
        held[0] += share
        held[1] += 1 - share
    hosts = runs.pop("")
    m = url_filter.UrlModel(dict.fromkeys(prior, 1) | {r: round(sum(c)) for r, c in runs.items()})
    words = {}
    for run, c in runs.items():
        for w in m.words(run):
            held = words.setdefault(w, [0.0, 0.0])
            held[0] += c[0]
            held[1] += c[1]
    m.learn(words, *hosts, frozenset(r for _, h, p in rules for r in url_filter.runs_of(h, p)), prior)
    return m


def test_odds_and_verdicts_equal_brute_force(spark):
    decided, unseen = split_names()
    rows = named_urls(decided[::3] + unseen[::5] + [("casino-win", "other.org"), ("gardencasino", "other.org")], 2)
    m = model_by_brute_force(rows, RULED, url_filter.PRIOR)
    for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=RULED).collect():
        want = m.odds(r.host, r.path)
        assert math.isclose(r.odds, want, abs_tol=1e-4)
        assert r.verdict == ("block" if r.host.endswith("bad.net") else "allow" if r.host.endswith("good.net") or want <= url_filter.LEAST_ODDS else "block")


def test_a_hot_host_weighs_as_any_other(spark):
    decided, unseen = split_names()
    few = named_urls(decided)
    hot = few + few[:1] * 400
    fitted = [url_filter.fit(spark.createDataFrame(rows, "page_id long, url string"), rules=RULED) for rows in (few, hot)]
    assert fitted[0].weight == fitted[1].weight and fitted[0].word == fitted[1].word and fitted[0].prior == fitted[1].prior


def test_judge(spark):
    rows = [(1, "http://casino-win.example.org/en/1", "x"), (2, None, "x"), (None, "http://a.net/fr/", "x"), (4, "", "x"), (4, "", "x"), (5, "http://school.example.org/" + "a" * 50000, "x")]
    got = {(r.page_id, r.verdict, r.rule) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()}
    assert got == {(1, "block", None), (2, "allow", None), (None, "block", "net/fr/"), (4, "allow", None), (5, "allow", None)}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def labelled_rows():
    docs, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = prose(i, 80)
        docs.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), f"s{i % 2}"))
        labels.append((i, int(good), 0))
    return docs, labels + [(7, None, 0), (8, 1, None), (None, 1, 0)]


def test_quality_held_out(spark):
    docs, labels = labelled_rows()
    docs += [(900, None, "s"), (901, "", "s"), (None, "text", "s")]
    d, y = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.classify(d, y).collect()
    assert len(rows) == len(docs)
    truth = {i: q for i, q, _ in labels if i is not None and q is not None}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(truth[r.doc_id] == r.predicted for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_edges(spark, clashing, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(no_documents, none).count() == 0
    model = quality.fit(clashing, none)
    assert {round(r.score, 6) for r in quality.classify(clashing, none).collect()} == {0.5}
    kept = quality.keep_good(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()


def test_every_block_counts():
    sizes = quality.Sizes((b"river stone light garden " * 40, True), (b"RIVER!! STONE!! LIGHT!! " * 40, True))
    good, bad = prose(1, 3000).encode(), prose(1, 3000).upper().replace(" ", "!! ").encode()
    assert sizes.features(good)[0] > sizes.features(bad)[0]
    assert sizes.features(good + bad)[0] < sizes.features(good)[0]
