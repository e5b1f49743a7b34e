import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import DATA, connect, same
from pyspark.sql import functions as F

from siltworks.llm import abuse, lines, mainbody, packing, queries, stuffing, terms, tokens


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.SQL[name], connect())


# ---- tokens ----

ODD = ["", " ", None, "a\x1cb \x1d\x1f  c", "x" * 3000, "ab" * 1500 + "  ", "<|endoftext|> hi", "it's 'LL don't", "日本語テキスト" * 200, "\x85\x0b\x0c a", "😀😀 �", "\r\n\r\n a", "Ünïcödé ͏a​b"]


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(ODD)] + [(0, "", "twice")], "doc_id long, text string, ids string")
    got = tokens.encode_documents(df).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        assert r.ids == t.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
    assert tokens.encode_documents(df.limit(0)).count() == 0


def test_long_pieces_merge_alike():
    e = tokens.Encoder()
    for s in ("abcabcabc" * 30, "  " * 200, "é" * 100):
        ids = e.byte_ids[np.frombuffer(s.encode(), np.uint8)]
        assert e._merge_long(ids.tolist()) == e._merge_matrix(ids[None, :])[0].tolist()


# ---- packing ----


def test_buckets_have_least_padding():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
        counts = rng.integers(1, 30, 9)
        for most in (1, 2, 4):
            cost = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
            best = min(cost([*e, lengths[-1]]) for k in range(most) for e in itertools.combinations(lengths[:-1], k))
            assert cost(packing.length_buckets(lengths, counts, most)) == best


def test_packing(spark):
    texts = [("word " * (i % 37)).strip() or None for i in range(400)] + ["", None, "long text " * 300]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(7, texts[7], 1)], "doc_id long, text string, place int")
    packs = spark.createDataFrame([("s", 16), ("m", 64), ("bad", None), (None, 5), ("m", 64)], "pack_name string, capacity int")
    rows = packing.pack_documents(docs, packs, buckets=8, shards=4).collect()
    want = Counter({r.doc_id: 0 for r in []})
    for r in tokens.token_counts(docs).collect():
        want[r.doc_id] += r.n_tokens
    for name, capacity in (("s", 16), ("m", 64)):
        own = [r for r in rows if r.pack_name == name]
        per, room, places = Counter(), Counter(), Counter()
        for r in own:
            per[r.doc_id] += r.n_tokens
            room[r.container_id] += r.n_tokens
            places[r.container_id, r.place] += 1
        assert per == Counter({k: v for k, v in want.items() if v})
        assert max(room.values()) <= capacity and max(places.values()) == 1
        pieces = Counter((r.doc_id) for r in own)
        assert all(pieces[d] == (1 if d != 7 else 2) for d, n in want.items() if 0 < n <= capacity)
        assert sum(per.values()) / (len(room) * capacity) > 0.85
    assert {r.pack_name for r in rows} == {"s", "m"}
    assert packing.pack_documents(docs.limit(0), packs).count() == 0
    assert packing.pack_documents(docs, packs.limit(0)).count() == 0


def test_repeated_pack_rows_push_no_pack_out(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    packs = spark.createDataFrame([("a", 16)] * 1200 + [("b", 64), ("b", 32)], "pack_name string, capacity int")
    assert {(r.pack_name, r.capacity) for r in packing.pack_documents(docs, packs, buckets=8, shards=4).collect()} == {("a", 16), ("b", 32)}
    with pytest.raises(ValueError):
        packing.pack_documents(docs, spark.range(packing.PACKS + 1).selectExpr("string(id) pack_name", "16 capacity"))


# ---- lines ----


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 80):
        s = rng.integers(0, 3, n)
        order, common = lines.suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        for a, b, c in zip(order[:-1], order[1:], common[1:], strict=True):
            k = 0
            while a + k < n and b + k < n and s[a + k] == s[b + k]:
                k += 1
            assert c == k


def page_frame(spark):
    rows = []
    for i in range(70):
        body = f"Unique {'abcdefghij'[i % 10] * (i // 10 + 1)}\nLegal  notice 20{i}\r\nSHARE this\n\nSometimes {i % 7 and 'not ' + 'x' * i}"
        rows.append((f"p{i}", f"https://www.big.org/{i}/?q", body))
    rows += [("p1", "https://big.org/1", "share this"), (None, "https://big.org/2#x", None), ("q", "mailto:x", "share this"), ("r", None, "share this")]
    rows += [(f"s{i}", f"http://small.org/{i}", "Only here" if i < 3 else None) for i in range(5)]
    return spark.createDataFrame(rows, "page_id string, url string, content string").withColumn("site", F.lit("clash"))


@pytest.mark.parametrize("shard", [1500, 11])
def test_repeated_lines(spark, monkeypatch, shard):
    monkeypatch.setattr(lines, "SHARD_PAGES", shard)
    pages = page_frame(spark)
    has, on = defaultdict(set), defaultdict(set)
    key = {"big": lambda u: u.split("big.org/")[1].split("/")[0].split("#")[0], "small": lambda u: u.rsplit("/", 1)[1]}
    for r in pages.collect():
        if r.content is None or not r.url or "org" not in r.url:
            continue
        site = "big" if "big.org" in r.url else "small"
        on[site].add(key[site](r.url))
        for x in r.content.split("\n"):
            x = lines_form(x)
            if x:
                has[site, x].add(key[site](r.url))
    want = {(s + ".org", x) for (s, x), p in has.items() if len(p) >= 3 and len(p) * 20 >= len(on[s])}
    assert {(r.site, r.line) for r in lines.repeated_lines(pages).collect()} == want
    assert ("big.org", "legal notice 0") in want and ("small.org", "only here") in want
    kept = {r.page_id: (r.kept, r.removed) for r in lines.without_repeated_lines(pages).collect()}
    assert kept["q"] == ("share this", 0) and "notice" not in kept["p5"][0] and kept["p5"][1] >= 2
    assert lines.repeated_lines(pages.limit(0)).count() == 0


def lines_form(x):
    import re

    return re.sub("[0-9]+", "0", re.sub("[ \t\r ]+", " ", x.lower()).strip(" "))


def test_blocks(spark):
    pages = spark.createDataFrame([(f"p{i}", f"http://a.org/{i}", f"t{'x' * i}\none\ntwo\nthree\nend{'y' * i}") for i in range(6)], "page_id string, url string, content string")
    got = lines.site_blocks(pages).collect()
    assert Counter((r.n_lines, r.n_pages) for r in got) == Counter({(1, 6): 3, (2, 6): 1, (3, 6): 1})


@pytest.mark.parametrize("shard", [1500, 11])
def test_blocks_against_counting(spark, monkeypatch, shard):
    """Blocks spread thinly over shards, blocks with equal extensions in some shards only, and one of more than 64 lines."""
    monkeypatch.setattr(lines, "SHARD_PAGES", shard)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(80):
        body = [f"own {'x' * i}"] + (["head", "menu", "left" if i % 3 else "right"] if i % 4 == 0 else ["menu"])
        body += list(rng.choice(["red", "green", "blue"], 4)) + ([f"long {'y' * k}" for k in range(70)] if i % 13 == 0 else [])
        rows.append((f"p{i}", f"http://a.org/{i}", "\n".join(body)))
    rows += [("p1", "http://a.org/1", "head\nmenu\nhead\nmenu"), ("p2", "http://b.org/1", "head\nmenu")]
    pages = spark.createDataFrame(rows, "page_id string, url string, content string")
    on = defaultdict(set)
    for _, u, c in rows:
        body = c.split("\n")
        if "a.org" in u:
            for a in range(len(body)):
                for b in range(a + 1, len(body) + 1):
                    on[tuple(body[a:b])].add(u)
    frequent = {k: len(v) for k, v in on.items() if len(v) >= 3 and len(v) * 20 >= 80}
    longest = Counter()
    for k, n in frequent.items():
        longest[k[:-1]] = max(longest[k[:-1]], n)
    want = Counter((len(k), n) for k, n in frequent.items() if len(k) == 1 or longest[k] < n)
    got = Counter((r.n_lines, r.n_pages) for r in lines.site_blocks(pages).collect())
    assert max(k for k, _ in want) >= 70 and got == want


# ---- terms ----


def posting_frame(spark):
    rows = []
    for i in range(40):
        u = f"https://a.org/{i}"
        rows.append((" The ", u, 2, [1, 2], f"2024-01-{i % 28 + 1:02d}"))
        rows.append(("THE", u + "/", 5, [1], "2023-01-01"))
        rows.append((f"t{i // 3}", u, None, list(range(i % 5)), "2024-01-01"))
        rows.append((f"t{i // 3}", "https://WWW.a.org/" + str(i), None, list(range(i % 5)), "2024-01-01"))
        rows.append((f"u{i // 9}", u, 1 + i % 4, None, None))
    rows += [(None, "https://a.org/1", 1, None, None), ("  ", "https://a.org/1", 1, None, None), ("lost", None, 1, None, None), ("lost", "mailto:x", 1, None, None)]
    df = spark.createDataFrame(rows, "term string, url string, frequency int, positions array<int>, at string")
    return df.withColumn("indexed_at", F.col("at").cast("timestamp")).withColumn("df", F.lit(1)).withColumn("count", F.lit(2)), rows


def test_terms(spark):
    postings, rows = posting_frame(spark)
    newest = {}
    for t, u, f, p, at in rows:
        t = (t or "").strip(" ").lower()
        if not t or not u or "org" not in u:
            continue
        k = (u.lower().replace("www.", "").rstrip("/"), t)
        v = (at or "", f if f is not None else len(p))
        newest[k] = max(newest.get(k, v), v)
    df = Counter(t for _, t in newest)
    n = len({u for u, _ in newest})
    counts = {r.term: (r.occurrences, r.df, r.mark) for r in terms.marked_terms(postings).collect()}
    mark = lambda d: "rare" if d <= 2 else "common" if d * 4 > n else None
    assert counts == {t: (sum(v[1] for (_, s), v in newest.items() if s == t), d, mark(d)) for t, d in df.items()}
    scored = {(r.url, r.term): (r.score, r.elite) for r in terms.score_terms(spark, postings).collect()}
    assert set(scored) == set(newest)
    for (u, t), (score, elite) in scored.items():
        assert score == pytest.approx(newest[u, t][1] * math.log(n / (1 + df[t]))) and 0 <= elite <= 1
    best = {}
    for (u, t), (score, _) in scored.items():
        if df[t] >= 2:
            best.setdefault(u, []).append((score, t))
    want = {u: min(t for s, t in v if s > max(v)[0] - 1e-9) for u, v in best.items()}
    assert {r.url: r.term for r in terms.characteristic_terms(spark, postings).collect()} == want
    assert terms.marked_terms(postings.limit(0)).count() == 0 and terms.characteristic_terms(spark, postings.limit(0)).count() == 0


def test_two_poisson_separates():
    rng = np.random.default_rng(3)
    k = np.concatenate([rng.poisson(0.2, 900), rng.poisson(9, 100)])
    counts = np.arange(k.max() + 1)[None, :].astype(float)
    elite = terms.two_poisson(counts, np.bincount(k)[None, :].astype(float))[0]
    assert elite[0] < 0.05 and elite[9] > 0.95 and (np.diff(elite) >= -1e-9).all()


# ---- pages ----


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        odds = rng.normal(0, 1.2, n)
        edges = [(a, b, float(rng.uniform(0, 1.5))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda y: sum(max(o, 0) if k == 0 else max(-o, 0) for o, k in zip(odds, y, strict=True)) + sum(c for a, b, c in edges if y[a] != y[b])  # noqa: B023, E731
        assert cost(mainbody.minimum_cut(odds, edges)) == pytest.approx(min(cost(y) for y in itertools.product((0, 1), repeat=n)))


def test_features_of_whole_lines():
    """What stands behind the 60th token of a line counts: its words, pairs, the line's end and its length."""
    base = "Plain " + "word " * 100
    assert {"wlate", "gword late", "zlate end"} <= set(mainbody.wording(base + "late end"))
    assert "wlate" not in mainbody.wording(base + "end") and "n20" in mainbody.wording("word " * 100)
    weights = np.zeros(1 << mainbody.BITS)
    weights[mainbody.bucket("wlate")], weights[mainbody.bucket("wplain")] = -3, 1
    label = lambda s: mainbody.label_lines(mainbody.Page(s, None, None, set()), mainbody.Classifier(weights))[0]
    assert [label(base + x) for x in ("late end", "end")] == [mainbody.FURNITURE, mainbody.MAIN]


def test_lists_of_any_length():
    """A run of title-shaped lines is found once, whatever its length, with its part of the page's words."""
    page = mainbody.Page("\n".join(["Read also:", *["The old mill"] * 5000, "Some words here"]), "Other", [True] + [False] * 5001, {"the"})
    assert set(page.runs[1:5001]) == {(1, 5000)} and page.runs[0] == (0, 0) and page.shares[5] > 0.99
    assert len(mainbody.label_lines(page, mainbody.Classifier(np.zeros(1 << mainbody.BITS)))) == 5002


def test_fit_does_not_depend_on_order_of_sets():
    pages = [([f"The {a} house stands near the {b} river." for _ in range(4)], 0) for a in "abcdefgh" for b in "klmnop"]
    spam = [(["cheap pills #one #two cheap cheap pills"] * 3, 30)] * 6
    one = stuffing.fit_prose(pages + spam, ["ok"] * len(pages) + ["spam"] * 6)
    assert (one.filler_shares(spam) > 0.5).all() and (one.filler_shares(pages) <= 0.5).all()
    assert one.filler_shares([([], 0), ([""], 3)]).tolist() == [0, 0]
    wrong = stuffing.fit_prose(pages + spam * 2, ["ok"] * len(pages) + ["spam"] * 10 + ["ok"] * 2)
    assert (wrong.filler_shares(spam) > 0.5).all()
    assert stuffing.fit_prose(pages, [None] * len(pages)).filler_shares(spam).max() == 0


def test_prose_of_stored_parts_is_that_of_all_pages(spark):
    """Counts of parts sum up to the model of all pages in memory."""
    texts = [([f"The {a} house stands near the {b} river.", f"It has {len(a + b)} old windows."], 1) for a in "abcdefgh" for b in "klmnop"]
    texts += [(["cheap pills #one #two cheap cheap pills"] * (2 + k % 3), 30) for k in range(12)]
    rows = [(i, str(i), "spam" if t[0].startswith("cheap") else "ok" if i % 3 else None, "\n".join(t), n, []) for i, (t, n) in enumerate(texts)]
    stored = spark.createDataFrame(rows, "row long, page_id string, label string, content string, links int, furniture array<long>").repartition(5, "row")
    fold = {r.page_id: r.fold for r in stored.select("page_id", F.pmod(F.xxhash64("page_id"), F.lit(stuffing.FOLDS)).alias("fold")).collect()}
    # fit_prose gives the folds in turn
    each = [[i for i in range(len(rows)) if fold[str(i)] == k] for k in range(stuffing.FOLDS)]
    order = [i for some in zip(*each, strict=False) for i in some]
    here = stuffing.fit_prose([texts[i] for i in order], [rows[i][2] for i in order])
    there = stuffing.fit_stored(stored.where(F.col("row").isin(order)))
    assert (there.low, there.high) == pytest.approx((here.low, here.high))
    assert all((a == b).all() for x, y in ((here.words, there.words), (here.lines, there.lines)) for c, d in zip(x.counts, y.counts, strict=True) for a, b in zip(c, d, strict=True))


def test_prose_learns_from_every_reviewed_page(spark):
    """Of 3400 reviewed pages the last 400 by the hash of their id are written text of a kind that the others don't show."""
    rng = np.random.default_rng(6)
    ids = [r.i for r in spark.range(3400).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("i")).orderBy(F.xxhash64("i")).collect()]
    words = ["house", "river", "garden", "window", "road", "stone", "light", "field", "bread", "winter"]
    plain = lambda: "\n".join(f"The {a} of the {b} was near a {c} and it stood there for many years." for a, b, c in rng.choice(words, (4, 3)))
    spam = lambda: "\n".join(" ".join(f"#{w}" if k % 2 else w for k, w in enumerate(rng.choice(["cheap", "pills", "buy", "now", "deal"], 14))) for _ in range(4))
    code = lambda: "\n".join(f"Set {a} = {n}; put {b} [{n}] = ({a} + {n}) * {b}; then give {a} / {b} % {n} - {n}; stop." for a, b in rng.choice(words, (4, 2)) for n in rng.integers(1, 99, 1))
    kind = ["code" if k >= 3000 else "spam" if k % 10 == 0 else "plain" for k in range(3400)]
    text = [{"code": code, "spam": spam, "plain": plain}[k]() for k in kind]
    pages = spark.createDataFrame([(i, f"http://s{n % 40}.org/{i}", "T", t) for n, (i, t) in enumerate(zip(ids, text, strict=True))], "page_id string, url string, title string, content string")
    labels = spark.createDataFrame([(i, "r", "spam" if k == "spam" else "ok") for i, k in zip(ids, kind, strict=True)], "page_id string, reviewer string, label string")
    found = {r.page_id for r in stuffing.stuffed_pages(stuffing.labelled_pages(pages, labels)).collect()}
    of = Counter(k for i, k in zip(ids, kind, strict=True) if i in found)
    assert of["spam"] >= 290 and of["plain"] <= 10 and of["code"] <= 10


@pytest.mark.parametrize("shard", [200_000, 3_000])
def test_furniture_is_learned_from_every_page(spark, monkeypatch, shard):
    """A service line recurs on sites whose pages are the last by the hash of their id; where it stands once it is furniture as well."""
    monkeypatch.setattr(stuffing, "SHARD_LINES", shard, raising=False)
    rng = np.random.default_rng(7)
    ids = [r.i for r in spark.range(2600).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("i")).orderBy(F.xxhash64("i")).collect()]
    words = ["house", "river", "garden", "window", "road", "stone", "light", "field", "bread", "winter"]
    prose = lambda: "The {} of the {} was near a {} and it stood there for many years.".format(*rng.choice(words, 3))
    short = lambda: "The {} by the {}".format(*rng.choice(words, 2))
    rows = []
    for k, i in enumerate(ids):
        site = f"own{k}" if k >= 2590 else f"late{k % 20}" if k >= 2000 else f"early{k % 20}"
        inside = "save this text to the purple drawer" if k >= 2000 else short()
        title = f"About {rng.choice(words)} {k}"
        rows.append((i, f"http://{site}.org/{i}", title, "\n".join([f"Menu of {site}", title, prose(), inside, prose()])))
    pages = spark.createDataFrame(rows, "page_id string, url string, title string, content string")
    labels = spark.createDataFrame([], "page_id string, reviewer string, label string")
    got = {r.page_id: set(r.furniture) for r in stuffing.labelled_pages(pages, labels).select("page_id", "furniture").collect()}
    assert sum(4 in got[i] for i in ids[2590:]) == 10
    assert sum(4 in got[i] for i in ids[:2000]) <= 20 and sum(bool({2, 3, 5} & got[i]) for i in ids) <= 20


def test_pages_edge_cases(spark):
    rows = [("A ", "http://a.org/1", None, "", "x"), ("b", None, "T", "\r\n \n", "x"), ("b", None, "T", "One line of text only", "x"), (None, "http://a.org/2", "T", None, "x"), ("c", "http://a.org/3", "T", "word " * 20000, "x"), ("c", "http://a.org/3", "T", "word " * 20000, "x")]
    pages = spark.createDataFrame(rows, "page_id string, url string, title string, content string, recurring string")
    labels = spark.createDataFrame([("b", None, None), ("c", "r1", "ok"), ("c", "r2", "spam")], "page_id string, reviewer string, label string")
    got = stuffing.labelled_pages(pages, labels)
    assert sorted(r.page_id for r in got.collect()) == ["a", "b", "b", "c", "c"]
    assert stuffing.stuffed_pages(got).count() == 0
    assert stuffing.labelled_pages(pages.limit(0), labels.limit(0)).count() == 0


def test_filler_and_furniture_on_held_out_pages(spark):
    """Pages not used for training whose reviewers agree, two or more: 'spam' pages are found and hardly any 'ok' page."""
    d = "/root/testdata/sf0.1"
    pages, labels = spark.read.parquet(d + "/visited_pages.parquet"), spark.read.parquet(d + "/page_labels.parquet").where("label is not null")
    held = F.pmod(F.xxhash64(F.lit("h"), F.col("page_id")), F.lit(3)) == 0
    got = {r.page_id: r.filler > 0.5 for r in stuffing.labelled_pages(pages, labels.where(~held)).collect()}
    votes = defaultdict(Counter)
    for r in labels.where(held).collect():
        votes[r.page_id.strip().lower()][r.label] += 1
    truth = {p: v["spam"] > 0 for p, v in votes.items() if len(v) == 1 and v.total() > 1 and p in got}
    assert sum(got[p] for p, y in truth.items() if y) >= 0.9 * sum(truth.values()) > 0
    assert sum(got[p] for p, y in truth.items() if not y) <= 0.03 * len(truth)


# ---- abuse ----


def test_canonical():
    assert abuse.canonical("you id1ot, I.D.I.O.T!") .split() == ["you", "idiot", "idiot"]
    assert abuse.canonical("ver­min frrreak rаt") == "vermin freak rat"
    assert abuse.canonical("a\nb").count("\n") == 1 and abuse.canonical("") == ""


def test_features_of_odd_lines():
    assert len(abuse.features([])[0]) == 0
    idx, owner = abuse.features(["", "a", "word word", "word word"])
    assert set(owner) == {1, 2, 3}
    assert sorted(idx[owner == 2]) == sorted(idx[owner == 3])


def test_abuse_learns_a_hidden_sentence(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("ran", "sol", "ting", "vek")]
    plain = lambda: " ".join(rng.choice(words, 6)) + "."
    rude = lambda: f"You {rng.choice(['filthy', 'rotten'])} {rng.choice(['zork', 'glob'])}, get lost."
    docs, labels = [], []
    for i in range(400):
        s = [plain() for _ in range(4)]
        bad = i % 4 == 0
        if bad:
            s[int(rng.integers(4))] = rude()
        docs.append((i, " ".join(s), "src"))
        if i < 300:
            labels.append((i, "r", "abusive" if bad else "clean"))
    docs += [(1000, None, None), (1001, "", "src"), (1002, " \n ", "src"), (1003, "y " * 30000, "src")]
    labels += [(1, "x", None), (5000, "x", "abusive")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("score", F.lit("clash"))
    got = abuse.score_documents(d, spark.createDataFrame(labels, "doc_id long, reviewer string, label string"))
    score = {r.doc_id: r.score for r in got.collect()}
    assert len(score) == len(docs)
    assert all((score[i] >= abuse.THRESHOLD) == (i % 4 == 0) for i in range(300, 400))
    assert score[1000] == score[1001] == score[1002] == 0
    nothing = abuse.score_documents(d, spark.createDataFrame([], "doc_id long, reviewer string, label string"))
    assert nothing.where(F.col("score") >= abuse.THRESHOLD).count() == 0
    assert abuse.source_rates(got).count() == 2
