"""Neighbours, near-duplicates, decontamination, main text: brute force and odd rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from quarry.llm import ann, components, decontam, html_labels, html_text, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)


def test_components_against_brute_force(spark):
    r = random.Random(1)
    edges = [(r.randrange(-60, 60), r.randrange(-60, 60)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def near_copies():
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(200)]
    out = []
    for _ in range(25):
        base = r.choices(words, k=r.randint(40, 300))
        out.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append("  ".join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    return out + ["", None, " \t", "one", "one two", "ONE two", "é à"]


def test_simhash_against_brute_force(spark):
    rows = list(enumerate(near_copies(), 10)) + [(None, "one"), (10, near_copies()[0])]
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (k, _), c in zip(rows, label, strict=True):
        if k is not None:
            least[c] = min(least.get(c, k), k)
    want = sorted((str(k), f"{p:016x}", str(least.get(c))) for (k, _), p, c in zip(rows, prints, label, strict=True))
    got = sorted((str(x["doc_id"]), x["fingerprint"], str(x["component_id"])) for x in simhash.grouped(docs(spark, rows)).collect())
    assert got == want and len(set(label)) < len(rows) - 10
    kept = simhash.deduplicated(docs(spark, rows))
    got = [x["doc_id"] for x in kept.collect()]
    assert sorted(got) == sorted(least.values()) and len(got) == len(set(label)) and kept.columns == docs(spark, []).columns
    assert simhash.grouped(docs(spark, [])).count() == 0


def test_simhash_drops_rows_not_ids(spark):
    r = random.Random(4)
    a, b, c = (" ".join(r.choices("abcdefghijklmnopqrstuvw", k=60)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, b + " "), (None, "lone words here")]
    got = [(x["doc_id"], x["text"]) for x in simhash.deduplicated(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (5, b), (7, c), (None, "lone words here")], key=str)


@pytest.mark.parametrize("exact", [0, 5, 16])
def test_trie_walk_against_brute_force(exact):
    r = np.random.default_rng(exact)
    base = r.integers(0, 1 << 62, 30, dtype=np.uint64)
    codes = [base, np.arange(40, dtype=np.uint64)]
    for _ in range(8):
        x = base.copy()
        for _ in range(3):
            x ^= np.uint64(1) << r.integers(0, 64, len(x), dtype=np.uint64)
        codes.append(x)
    c = np.unique(np.concatenate(codes))
    label = np.arange(len(c))
    for i in range(len(c)):
        near = np.bitwise_count(c ^ c[i]) <= 3
        if exact:
            near &= c >> np.uint64(64 - exact) == c[i] >> np.uint64(64 - exact)
        for x in set(label[near]):
            label[label == x] = label[near].min()
    assert (simhash.walk(c, exact) == label).all()


def cut(text):
    return [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]


def brute_leaks(rows, items):
    out = set()
    for k, t in rows:
        w = cut(t)
        for item, text in items:
            x = cut(text)
            size = min(13, len(x))
            if not x:
                continue
            for place in range(-len(x), len(w)):
                eq = [0 <= place + i < len(w) and w[place + i] == y for i, y in enumerate(x)]
                if any(sum(eq[i : i + size]) >= 0.8 * size for i in range(len(eq) - size + 1)):
                    out.add((k, item))
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(6)
    words = ["".join(r.choices("abcd", k=2)) for _ in range(12)]
    items = [(k, " ".join(r.choices(words, k=n))) for k, n in enumerate([14, 20, 30, 13, 12, 9, 5, 6, 4, 10, 3, 2])] + [(50, None), (51, "")]
    rows = []
    for k in range(60):
        w = r.choices(words, k=r.randint(0, 30))
        if k % 2:
            x = cut(r.choice(items[:12])[1])
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = "zz"
            low = r.randrange(len(x)) if r.random() < 0.3 else 0
            at = r.randint(0, len(w))
            w[at:at] = x[low:]
        rows.append((k, ", ".join(w).upper() if k % 3 else " ".join(w)))
    rows += [(900, None), (901, ""), (3, rows[3][1])]
    bench = spark.createDataFrame([*items, items[0]], "item_id bigint, text string")
    want = brute_leaks(rows, items)
    for few in (decontam.BROADCAST, 0):
        got = decontam.contaminated(docs(spark, rows), bench, few).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)
    kept = decontam.clean(docs(spark, [*rows, (None, "nothing"), (None, rows[1][1])]), bench)
    bad = {k for k, _ in want}
    assert sorted(x["doc_id"] for x in kept.where("doc_id is not null").collect()) == sorted(k for k, _ in rows if k not in bad)
    assert decontam.clean(docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontam.contaminated(docs(spark, []), bench).count() == 0


def test_masks_leave_no_window_without_a_hit():
    from itertools import combinations

    for bad in combinations(range(decontam.WINDOW), 2):
        assert any(not {s + k for k in m} & set(bad) for m in decontam.MASKS for s in range(decontam.WINDOW - m[-1]))


def test_neighbours_recall_and_odd_rows(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(1500, 12)) * r.uniform(0.5, 2, size=(1500, 1))
    v[700:760] = v[700]
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 12, 0), (2003, [float("nan")] * 12, 0), (2004, [None] * 12, 0), (None, [1.0] * 12, 0), (2005, [float("inf")] * 12, 0), (2020, [1.0, 2.0], 0), (2021, [2.0, 1.0], 0), (40, v[40].tolist(), 0)]
    out = ann.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), shards=3).collect()
    by = {}
    for x in out:
        by.setdefault(x["query_id"], []).append(x)
    assert set(by) == {*range(0, 1500, 20), 2020}
    hits = total = 0
    for q, found in by.items():
        found.sort(key=lambda x: x["rank"])
        assert [x["rank"] for x in found] == list(range(1, len(found) + 1)) and all(x["vec_id"] != q for x in found)
        assert [(-x["score"], x["vec_id"]) for x in found] == sorted((-x["score"], x["vec_id"]) for x in found)
        if q == 2020:
            assert [(x["vec_id"], x["score"]) for x in found] == [(2021, 4.0)]
            continue
        exact = v @ v[q]
        exact[q] = -np.inf
        limit = np.sort(exact)[-20]
        hits, total = hits + sum(x["score"] >= limit - 1e-9 for x in found), total + 20
        assert all(abs(x["score"] - v[x["vec_id"]] @ v[q]) < 1e-9 for x in found)
    assert hits / total > 0.95
    assert ann.neighbours(spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")).count() == 0


def test_crowds_of_equal_vectors_give_the_least_ids(spark):
    rows = [(k, [1.0, 0.0], 0) for k in range(100)]
    out = ann.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), every=60, k=5).collect()
    assert sorted(x["vec_id"] for x in out if x["query_id"] == 0) == [1, 2, 3, 4, 5]


def test_main_text_of_unseen_pages():
    model, held = html_text.model(), html_labels.pages(40, seed=77)
    good = [html_text._overlap(model.text("".join(m for m, _ in page)), html_text.truth(page)) for page in held]
    assert np.mean(good) > 0.97


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words", "plain words"), ("<p>a&nbsp;b &amp;\n c&#33;</p>", "a b & c!"), ("<p>one<br>two<b>three</b></p>", "one twothree"),
    ("<nav>menu here</nav><p>Body of text.</p><footer>foot</footer>", "Body of text."), ("<p>open <p>next</div> end", "open next end"), ("<script>var a='<p>x</p>'</script><p>kept words</p>", "kept words"),
    ("<p>see 3 < 4 and <!-- hidden --> more</p>", "see 3 < 4 and more"), ("<!-- never closed <p>x</p>", ""), ("<p>text of it</p><div class='comments'><p>a reader says a lot of words here</p></div>", "text of it"),
])
def test_main_text_cases(page, want):
    assert html_text.model().text(page) == want


def test_main_text_rows(spark):
    rows = [(1, "u", "<p>a b</p>", "clash"), (2, None, None, "clash"), (1, "u", "<p>a b</p>", "clash")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert sorted((x["page_id"], x["text"], x["n_chars"]) for x in out.collect()) == [(1, "a b", 3), (1, "a b", 3), (2, "", 0)]
    assert out.limit(0).count() == 0


def test_decontamination_twin(spark):
    import duckdb

    from quarry.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    want = set(con.sql(queries.oracle_sql()["op8_decontamination"]).fetchall())
    out = queries.op8_decontamination(spark, "/root/testdata/sf0.01")
    assert {(r["doc_id"], r["item_id"], r["n_equal"], r["n_words"]) for r in out.collect()} == want and want
    assert dict(out.dtypes) == {c: "bigint" for c in ("doc_id", "item_id", "n_equal", "n_words")}
