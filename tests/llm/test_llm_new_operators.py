"""Vector codes, URL reputation and fill-in-the-middle against plain loops, with odd inputs."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.llm import fill_in_middle as fim
from lotwise.llm import url_reputation as urls
from lotwise.llm import vector_codes as vc


# ------------------------------------------------------------------ vector codes


@pytest.mark.parametrize("width,size", [(8, 40), (8, 3), (1, 5), (5, 2**25 - 1), (64, 900)])
def test_nearest_entry_is_exact_and_prunes(width, size):
    rng = np.random.default_rng(width)
    entries = rng.integers(-size, size + 1, (16, width))
    entries[9] = entries[4]  # a tie goes to the lower number
    values = np.concatenate([rng.integers(-size, size + 1, (3000, width)), entries, entries[3:4] + rng.integers(-1, 2, (500, width))])
    entry, distance, computed = vc.Codebook(entries).nearest(values)
    every = ((values[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    assert (entry == every.argmin(1)).all() and (distance == every.min(1)).all() and 9 not in entry
    assert computed <= len(values) * 16


def test_segment_means_leave_few_distances():
    rng = np.random.default_rng(1)
    walks = rng.integers(-9, 10, (2016, 64)).cumsum(1)  # neighbouring components are alike
    _, _, computed = vc.Codebook(walks[:16]).nearest(walks)
    assert computed < 0.15 * len(walks) * 16


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 2**32 - 1))
def test_bounds_never_lose_the_nearest(width, seed):
    rng = np.random.default_rng(seed)
    scale = 10 ** rng.integers(0, 8)
    entries = rng.integers(-scale, scale + 1, (rng.integers(1, 17), width)) % (1 << 24)
    values = np.concatenate([entries + rng.integers(-2, 3, entries.shape), rng.integers(-scale, scale + 1, (50, width)) % (1 << 24)])
    entry, distance, _ = vc.Codebook(entries).nearest(values)
    every = ((values[:, None, :] - entries[None]) ** 2).sum(2)
    assert (entry == every.argmin(1)).all() and (distance == every.min(1)).all()


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector of ints)."""
    rows = sorted(rows)
    width = -(-len(rows[0][1]) // parts)
    cut = [[tuple((list(v) + [0] * (width * parts - len(v)))[k * width : (k + 1) * width]) for k in range(parts)] for _, v in rows]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]
    dist = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    assign = lambda: [[min(range(len(books[k])), key=lambda e: (dist(c[k], books[k][e]), e)) for k in range(parts)] for c in cut]
    for _ in range(rounds):
        found = assign()
        for k in range(parts):
            for e in range(len(books[k])):
                own = [c[k] for c, f in zip(cut, found, strict=True) if f[k] == e]
                if own:
                    books[k][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    return [(i, "".join(f"{e:02x}" for e in f), sum(dist(c[k], books[k][e]) for k, e in enumerate(f))) for (i, _), c, f in zip(rows, cut, assign(), strict=True)], books


def test_vector_codes_on_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(int(i), rng.normal(size=20).astype(float).tolist(), int(i) % 3 or None) for i in range(60)]
    good += [(7, good[7][1], 1), (8, good[9][1], 1)]  # repeated ids, equal vectors
    bad = [(100, None, 1), (101, [1.0, None] * 10, 1), (102, [float("nan")] * 20, None), (103, [float("inf")] * 20, 2)]
    other = [(200, [0.5] * 4, 1), (201, [], 9), (202, [1e300, -1e300] * 10, 1), (None, good[3][1], None)]
    frame = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in good + bad + other], "vec_id long, embedding array<double>, label int, v string, code int").repartition(5)
    found = vc.vector_codes(frame).collect()
    want, books = brute_codes([(i if i is not None else 10**6, [math.floor(4096 * x) for x in v]) for i, v, _ in good + other[3:]])
    live = sorted((r.vec_id if r.vec_id is not None else 10**6, r.code, r.error) for r in found if r.code is not None)
    assert live == sorted(want)
    assert sorted(r.vec_id for r in found if r.code is None) == [200, 201, 202] and len(found) == len(good) + 4
    labels = {i: y for i, _, y in good + other}
    errors = {}
    for r in found:
        errors.setdefault(r.label_error, set()).add(labels[r.vec_id] if r.vec_id not in (7, 8) else 1)
    by_label = {}
    for (i, _, y), e in zip(sorted(good + other[3:], key=lambda t: (t[0] if t[0] is not None else 10**6, t[1])), [e for _, _, e in want], strict=True):
        by_label[y] = by_label.get(y, 0) + e
    assert {r.label_error for r in found if r.code is not None} == set(by_label.values())
    text = ",".join(str(x) for book in books for e in book for x in e)
    assert {r.codebooks_sha256 for r in found} == {hashlib.sha256(text.encode()).hexdigest()}
    assert vc.vector_codes(frame.limit(0)).count() == 0
    assert [r.code for r in vc.vector_codes(frame.filter("vec_id in (100, 101, 200)")).collect()] == ["00" * 8]  # one vector is its own codebook
    kept = vc.kept_vectors(frame.filter("vec_id < 60"))
    codes = vc.fit(kept, rounds=2)
    row = vc.encode(kept, codes).first()
    assert len(codes.decode(bytes.fromhex(row.code))) == 20


# ------------------------------------------------------------------ url reputation


def test_url_parts_and_rules(spark):
    cases = {
        "http://Tion.Example.NET/en/78?x=1": ("tion.example.net", "/en/78", "allow", "example.net/en/"),
        "https://a.net": ("a.net", "", None, None),  # the empty path starts with no rule's path
        "https://a.net/": ("a.net", "/", "block", "net/"),
        "https://net/x#y": ("net", "/x", "block", "net/"),
        "https://xnet/x": ("xnet", "/x", None, None),
        "//example.com/de/": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
        "a://b://c.org/fr/x": ("b:", "//c.org/fr/x", None, None),
        "ftp://x.example.com/de/?q": ("x.example.com", "/de/", "block", "example.com/de/"),
        "x://ÄB.Example.org/fr/é\n": ("Äb.example.org", "/fr/é\n", "allow", "org/fr/"),
        "x://h.org#f/fr/": ("h.org", "", None, None),
    }
    frame = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = urls.url_parts(frame["url"])
    found = frame.select("url", host.alias("h"), path.alias("p"), urls.rule_of(host, path).alias("r")).collect()
    assert {r.url: (r.h, r.p, r.r and r.r.verdict, r.r and r.r.rule) for r in found} == cases


def test_domains(spark):
    cases = {"a.b.example.com": ("example.com", "com"), "x.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "localhost": ("localhost",) * 2, "10.0.0.1": ("10.0.0.1",) * 2,
             "u@w.example.de:80": ("example.de", "de"), "": ("", ""), "[::1]:80": ("[::1]",) * 2, "a..b": ("a..b",) * 2}
    frame = spark.createDataFrame([(h,) for h in cases], "host string")
    domain, suffix = urls.domain_and_suffix(frame["host"])
    assert {r.host: (r.d, r.s) for r in frame.select("host", domain.alias("d"), suffix.alias("s")).collect()} == cases


def test_beta_tail_against_numeric_integration():
    for a, b, x in [(0.3, 0.7, 0.5), (2, 5, 0.5), (40.5, 3.25, 0.9), (900, 1100, 0.47), (1, 1, 0.25), (5e4, 5e4, 0.5), (0.5, 2000, 0.001)]:
        t = np.linspace(0, 1, 2_000_001)
        u = (t[1:] + t[:-1]) / 2
        w = u ** (1 / min(a, 1)) if a < 1 else u  # substitution takes the pole at 0 away
        log = (a - 1) * np.log(w) + (b - 1) * np.log1p(-w) + (np.log(w / u) if a < 1 else 0)
        mass = np.exp(log - log.max())
        want = mass[w > x].sum() / mass.sum()
        assert abs(urls.beta_tail(np.array([a]), np.array([b]), x)[0] - want) < 2e-4, (a, b, x)


def plain_hierarchy(counts):
    """host -> (domain, suffix, n, bad) to posterior (a, b), one loop per level."""
    n, bad = sum(c[2] for c in counts.values()), sum(c[3] for c in counts.values())
    means = {None: (bad + 0.5) / (n + 1)}
    for level, parent_of in ((1, lambda h: None), (0, lambda h: counts[h][1]), (None, lambda h: counts[h][0])):
        own = {}
        for h, c in counts.items():
            key = h if level is None else c[level]
            k, m, _ = own.get((level, key), (0, 0, None))
            own[(level, key)] = (k + c[2], m + c[3], means[parent_of(h) if level == 1 else (1, parent_of(h)) if level == 0 else (0, parent_of(h))])
        seen = sum(k * (m / k - p) ** 2 for k, m, p in own.values() if k)
        even = sum(p * (1 - p) for k, _, p in own.values() if k)
        slope = sum(p * (1 - p) * (k - 1) for k, _, p in own.values() if k)
        rho = min(max((seen - even) / slope if slope else 0.0, 1e-4), 0.9)
        posterior = {key: (m + (1 / rho - 1) * p, k - m + (1 / rho - 1) * (1 - p)) for key, (k, m, p) in own.items()}
        means |= {key: a / (a + b) for key, (a, b) in posterior.items()}
    return {h: posterior[(None, h)] for h in counts}


@pytest.fixture(scope="module")
def web(spark):
    """A bad host and a bad domain among good ones, hosts without labels, odd rows."""
    rows, labels, i = [], [], 0
    for host, pages, bad in [("bad.good.com", 40, 38), ("a.good.com", 60, 2), ("b.good.com", 50, 1), ("x.farm.com", 30, 28), ("y.farm.com", 25, 24), ("z.farm.com", 2, 2), ("new.farm.com", 5, None), ("one.quiet.org", 1, 1), ("q.quiet.org", 30, 0)]:
        for k in range(pages):
            rows.append((i, f"http://{host.upper() if k % 2 else host}/p{k}", "x", 1))
            if bad is not None:
                labels.append((i, int(k < bad)))
            i += 1
    rows += [(None, "http://a.good.com/null-id", "x", 1), (0, "http://bad.good.com/again", "x", 1), (i, None, "x", 1), (i + 1, "no scheme", None, 1), (i + 2, "http://w.net/", "x", 1), (i + 3, "http://bad.good.com/x", "x", 1)]
    labels += [(3, None), (None, 1), (0, 0)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, host string, confidence int"), spark.createDataFrame(labels, "id long, bad int")


def test_reputation_against_plain_loops(spark, web):
    rows, pages, outcomes = web
    worst = {}
    for r in outcomes.collect():
        if r.id is not None and r.bad is not None:
            worst[r.id] = max(worst.get(r.id, 0), r.bad)
    counts = {}
    for i, url, *_ in rows:
        host = re.match("[^/?#]*", url.split("://", 1)[1])[0].lower() if url and "://" in url else ""
        domain = ".".join(host.split(".")[-2:])
        own = counts.setdefault(host, [domain, host.split(".")[-1], 0, 0])
        if i in worst:
            own[2] += 1
            own[3] += worst[i]
    posterior = plain_hierarchy(counts)
    known = {r.host: r for r in urls.reputations(urls.host_counts(pages, outcomes)).collect()}
    assert known.keys() == posterior.keys()
    for host, (a, b) in posterior.items():
        assert math.isclose(known[host].bad_rate, a / (a + b), rel_tol=1e-9) and math.isclose(known[host].confidence, urls.beta_tail(np.array([a]), np.array([b]), urls.LIMIT)[0], abs_tol=1e-9)
    blocked = {h for h, r in known.items() if r.confidence >= urls.CONFIDENCE}
    assert {"bad.good.com", "x.farm.com", "y.farm.com"} <= blocked and not blocked & {"a.good.com", "b.good.com", "one.quiet.org", "q.quiet.org", "w.net", ""}
    assert known["new.farm.com"].bad_rate > 0.6  # leans on its domain
    judged = urls.judge(pages, outcomes).collect()
    assert len(judged) == len(rows)
    assert all(r.verdict == ("block" if r.rule == "net/" or r.host in blocked and r.rule is None else "allow") for r in judged)
    kept = urls.keep_allowed(pages, outcomes)
    assert kept.columns == pages.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in pages.collect() if (r.url or "").lower().split("/")[2:3] not in [[h] for h in blocked | {"w.net"}])


def test_reputation_without_labels_and_rows(spark, web):
    _, pages, outcomes = web
    assert {r.verdict for r in urls.judge(pages, outcomes.limit(0)).filter("rule is null").collect()} == {"allow"}
    assert urls.judge(pages.limit(0), outcomes).count() == 0 and urls.keep_allowed(pages.limit(0), outcomes).count() == 0
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, None), (6, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    shown = spark.createDataFrame([(1, "h://a/en/5?x"), (2, "h://a/5.html#y"), (3, "h://a/6/"), (4, "h://a/7/"), (5, "h://a/77777777777777777777"), (6, None), (7, "h://a/7/b")], "page_id long, url string")
    assert sorted(map(tuple, urls.page_outcomes(shown, labels).collect())) == [(1, 1), (2, 1), (4, 1)]


# ------------------------------------------------------------------ fill in the middle

PATTERNS = {"lines": "[^\n]*\n|[^\n]+", "words": r"(?s)[^ \t\n\v\f\r]*[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+", "characters": "(?s)."}


def plain_cut(text, doc_id, unit, rate=100, spm_rate=50):
    units = re.findall(PATTERNS[unit], text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x]) for x in (slice(0, a), slice(a, b), slice(b, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h[3] % 100 < spm_rate else (n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


TEXTS = ["", None, "\n", "a", "a\nb", "\n\n\n", "zeile ä\nzwei €\n\U0001f600 drei", "x<P>y\nz", "<", "S>\n<S", "no <S >\n<M\n>", "<M>", " a  b ", "\r\n\r\n", "tail\n", "é" * 7, "\x00\n\x00", "<S\n>"] + [f"line {k}\n" * k for k in range(40)]


@pytest.mark.parametrize("unit", sorted(fim.UNITS))
def test_fill_in_middle_against_plain_cuts(spark, unit):
    rows = [(i % 50 if i else None, t, "x", 5) for i, t in enumerate(TEXTS * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    found = fim.fill_in_middle(frame, unit)
    key = lambda t: tuple((x is not None, x) for x in t)
    want = sorted(((i, *plain_cut(t or "", i, unit)) for i, t, *_ in rows), key=key)
    assert sorted((tuple(r)[:6] for r in found.select("doc_id", "n", "form", "output", "prefix_chars", "middle_chars").collect()), key=key) == want
    back = found.select("doc_id", fim.restored(found["output"], found["form"]).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((i, t or "") for i, t, *_ in rows), key=key)
    assert fim.fill_in_middle(frame.limit(0), unit).count() == 0
    some = fim.fill_in_middle(frame, unit, rate=30, spm_rate=80)
    assert sorted((tuple(r)[:3] for r in some.select("doc_id", "n", "form").collect()), key=key) == sorted(((i, *plain_cut(t or "", i, unit, 30, 80)[:2]) for i, t, *_ in rows), key=key)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n<PSM>é\U0001f600", max_size=30), max_size=12), st.sampled_from(sorted(fim.UNITS)), st.integers(1, 40))
def test_kernel_on_any_batch(texts, unit, most):
    array = pa.array(texts, pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[: len(texts) + 1] if texts else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    draws = np.array([[int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] for i in range(len(texts))], np.int64).reshape(-1, 4)
    got = []
    for part in fim.slices(np.diff(offsets), most):
        own = offsets[part.start : part.stop + 1]
        r = fim.reorder(data[own[0] : own[-1]], own - own[0], draws[part], fim.UNITS[unit], 100, 50, fim.SENTINELS)
        got += list(zip(r["n"].tolist(), r["form"].tolist(), r["output"], r["prefix_chars"].tolist(), r["middle_chars"].tolist(), strict=True))
    want = [plain_cut(t, i, unit) for i, t in enumerate(texts)]
    assert got == [(n, f, o.encode(), -1 if p is None else p, -1 if m is None else m) for n, f, o, p, m in want]


def test_long_text_is_cut_whole(spark):
    text = "".join(f"zeile {k} ä\n" for k in range(600_000))  # over SLICE_BYTES
    assert len(text.encode()) > fim.SLICE_BYTES
    row = fim.fill_in_middle(spark.createDataFrame([(3, "kurz"), (1, text)], "doc_id long, text string")).filter("doc_id = 1").first()
    assert (row.n, row.form, row.output, row.prefix_chars, row.middle_chars) == plain_cut(text, 1, "lines")
