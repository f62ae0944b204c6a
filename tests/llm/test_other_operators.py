"""Near-duplicates, chat, packing, URLs and vectors against brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import chat, packing, queries, simhash, urls, vectors
from tessella.llm.common import connected_components

DOCS = "doc_id long, text string"


def components(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def brute_fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b\tC d\x0be É f", "x y z " * 40, "a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("subtree", [20_000, 5])
def test_near_duplicates_match_brute_force(spark, subtree):
    rng = random.Random(1)
    prints = [0, 7, 2**64 - 1]
    for _ in range(25):
        prints.append(rng.getrandbits(64))
        for _ in range(rng.randint(0, 12)):
            prints.append(prints[-1] ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame(list(zip(signed, range(len(prints)), strict=True)), "fingerprint long, node long")
    found = {r.node: r.component for r in connected_components(simhash.linked_fingerprints(distinct, 3, subtree)).collect()}
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert [found.get(i, i) for i in range(len(prints))] == components(len(prints), links)


def test_near_duplicate_documents(spark):
    text = "one two three four five six seven eight nine ten " * 30
    rows = [(5, text), (3, text), (9, text), (4, None), (2, ""), (7, "another text with words of its own here"), (7, "another text with words of its own here")]
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 4: 2, 2: 2, 7: 7}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 7, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    nodes = sorted({x for p in links for x in p})
    place = {x: i for i, x in enumerate(nodes)}
    label = components(len(nodes), [(place[a], place[b]) for a, b in links])
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found.get(x, x) == nodes[label[place[x]]] for x in nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


NASTY = ["\\### Assistant: </turn> ok", "", "a\\", "<turn>### x: y</turn>\n", ": : \\: #<", "你好 𝒳 é", "\n\n", "<|endoftext|>"]


def test_chat_round_trip_and_mask(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "odd: role\\"]), rng.choice([*NASTY, None, "plain words here"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for part in (10**6, 5):
        seen: dict = {}
        ids: dict = {}
        for r in sorted(chat.format_conversations(df, part_chars=part).collect(), key=lambda r: (r.conv_id, r.part)):
            texts, masked = seen.setdefault(r.conv_id, ([], []))
            texts += chat.parse(r.formatted)
            formatted, own = ids.setdefault(r.conv_id, ([], []))
            formatted.append(r.formatted)
            own += r.ids
            masked.append("".join(r.formatted[m.start : m.end] for m in r["mask"]))
            assert all(0 <= m.token < len(r.ids) for m in r["mask"])
            if r.summary:
                summary = r.summary
                want = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
                assert texts == [(role, text) for _, role, text in want]
                said = "".join(text for _, role, text in want if role == "assistant")
                assert chat.unescape("".join(masked)) == said
                assert (summary.n_turns, summary.loss_chars, summary.loss_sha256) == (len(want), len(said), hashlib.sha256(said.encode()).hexdigest())
                assert summary.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in want).encode()).hexdigest()
        assert set(seen) == {r[0] for r in rows}
        encode = chat.encoder()
        assert all(own == encode("".join(formatted))[0] for formatted, own in ids.values())  # pieces change no id
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_a_conversation_over_many_ranges(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"turn {i} \\<#: {'x' * (i % 7)}") for i in range(3000)] + [(None, None, None, None), (None, 1, "user", "b"), (None, 1, "user", "b"), (6, 0, "assistant", "z" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).repartition(7)
    got = {r.conv_id: r.summary for r in chat.format_conversations(df, part_chars=10_000, outputs=False).collect()}
    said = "".join(t for c, _, role, t in rows if c == 5 and role == "assistant")
    assert set(got) == {5, 6, None} and got[None].n_turns == 3 and got[6].loss_chars == 300_000
    assert (got[5].n_turns, got[5].loss_sha256) == (3000, hashlib.sha256(said.encode()).hexdigest())
    assert got[5].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for c, _, role, t in rows if c == 5).encode()).hexdigest()


def test_mask_equals_a_scan_over_characters():
    rng = np.random.default_rng(0)
    for _ in range(50):
        cuts = np.sort(rng.choice(np.arange(1, 60), 12, replace=False))
        offsets = np.column_stack([np.concatenate([[0], cuts]), np.concatenate([cuts, [60]])])
        ends = np.sort(rng.choice(np.arange(61), 6, replace=False)).reshape(-1, 2)
        spans = [tuple(map(int, e)) for e in ends]
        token, a, b = chat.mask(offsets, spans)
        want = {(i, c) for i, (s, e) in enumerate(offsets) for c in range(s, e) if any(x <= c < y for x, y in spans)}
        assert {(int(t), c) for t, s, e in zip(token, a, b, strict=True) for c in range(s, e)} == want


def test_packing_encoder_is_the_json_vocabulary():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.vocabulary_encoder()
    rng = random.Random(6)
    texts = [*NASTY, "x <|endoftext|> y<|endoftext|><|endoftext|>", "I'll we've  it's\t\t x\r\n", "ﬀ ① ½ ٣ 한국어 ‍👩‍👩‍👧 á", "a" * 3000, " " * 500, " " * 1_200_000 + "x", "\n" * 1_200_000, "".join(chr(rng.choice([*range(32, 1000), *range(0x4E00, 0x4E80)])) for _ in range(3000))]
    for text in texts:
        assert encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_packing_places_every_token_once(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "é", "qq"]) for _ in range(rng.choice([0, 1, 5, 300, 2500])))) for i in range(120)] + [(500, None), (501, ""), (501, "")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = packing.pack(df, round_tokens=20_000).toPandas()
    encode = packing.vocabulary_encoder()
    assert got.length.sum() == sum(len(encode(t or "")) + 1 for _, t in rows)
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        total = int(part.length.sum())
        assert part.offset.tolist() == np.concatenate([[0], np.cumsum(part.length)[:-1]]).tolist()
        assert total == part.sequence_length.iloc[0] and (total == 1024 or total & (total - 1) == 0)
    one = got[got.doc_id == 3].sort_values("start")
    ids = np.array([*encode(rows[3][1]), 0], dtype="<u4")
    import zlib

    assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(one.start, one.length, strict=True)] == one.ids_crc32.tolist()
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_balances_cost():
    lengths = [700, 600, 500, 400, 300, 200, 100, 100, 90, 82]
    placed = packing.pack_round(lengths, 1024)
    cost: dict = {}
    for _, _, n, k, _ in placed:
        cost[k] = cost.get(k, 0) + packing.attention_cost(n, 1, 1 / 512)
    assert sum(n for _, _, n, _, _ in placed) == sum(lengths) and max(cost.values()) < 1.5 * min(cost.values())


def test_url_parts_and_rules(spark):
    rows = ["http://A.Example.com/en/70?x#y", "https://b.net/de/8", "http://example.net/de/81", "x", None, "http://", "http://h?/en/", "HTTP://COM/en/://z", "http://notcom/en/", "http://a.org/es/\n?q", "http://u:p@x.com:80/en/", "//com/en/", "http://" + "a." * 3000 + "com/en/1"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    listed = spark.createDataFrame([("h",), (None,), ("unseen",), ("notcom",)], "host string")
    got = {r.page_id: (r.host[-12:], r.path, r.rule, r.verdict) for r in urls.judge(df, queries.RULES, listed).collect()}
    assert got[0] == ("a.example.com"[-12:], "/en/70", "example.com/en/7", "allow")
    assert got[1][2:] == ("net/de/", "allow") and got[2][2:] == ("example.net/de/8", "block")
    assert got[3] == got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("h", "", None, "block") and got[7][2:] == ("com/en/", "block") and got[8][2:] == (None, "block")
    assert got[9] == ("a.org", "/es/\n", "org/es/", "block") and got[10][2] is None and got[11][:2] == ("", "") and got[12][2] == "com/en/"
    assert urls.judge(df.limit(0), queries.RULES, listed.limit(0)).count() == 0


@pytest.mark.parametrize("listed", [0, 1, 40, 1500, 2000])
def test_cascade_is_exact_over_its_universe(spark, listed):
    universe = spark.range(2000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), (F.col("id") < listed).alias("listed"))
    cascade = urls.build_cascade(universe)
    pdf = universe.toPandas()
    assert (cascade.contains(pdf.h1.to_numpy(), pdf.h2.to_numpy()) == pdf.listed.to_numpy()).all()


def test_more_hosts_than_one_bitmap_holds_are_judged_in_parts(spark):
    hosts = [f"h{i}.org" for i in range(3000)]
    rows = [(k, f"http://{hosts[k % 3000]}/x") for k in range(4000)] + [(-1, None), (-2, "http://a.example.com/en/70"), (-3, "no url")]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    listed = spark.createDataFrame([(h,) for h in hosts[::3]] + [(None,), ("unseen",), ("",)], "host string")
    universe = urls._universe(pages.select(urls.host_of(F.col("url")).alias("key")), listed.select(F.col("host").alias("key")))
    assert urls.parts_of(universe) == 1 and urls.parts_of(universe, 200) == 2
    whole = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, queries.RULES, listed).collect()}
    want = {k: (None, "block" if k % 3000 % 3 == 0 else "allow") for k in range(4000)}
    want |= {-1: (None, "block"), -2: ("example.com/en/7", "allow"), -3: (None, "block")}
    assert whole == want
    for size in (200, 70):  # two parts, six parts
        assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, queries.RULES, listed, size).collect()} == want


def test_rules_of_one_length_and_long_urls(spark):
    rules = [("block", "b.com", "/x/y"), ("allow", "a.b.com", "/x"), ("block", "c.com", "/"), ("allow", "c.com", "/")]
    long = "http://c.com/" + "z" * 1_000_000
    pages = spark.createDataFrame([(1, "http://a.b.com/x/y"), (2, "http://b.com/x/y"), (3, long)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules, spark.createDataFrame([], "host string")).collect()}
    assert got == {1: ("a.b.com/x", "allow"), 2: ("b.com/x/y", "block"), 3: ("c.com/", "allow")}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for cluster in range(40):
        centre = rng.standard_normal(24)
        for _ in range(int(rng.choice([1, 2, 5, 90 if cluster == 0 else 3]))):
            rows.append((n, (centre + 0.08 * rng.standard_normal(24)).astype(np.float32).tolist(), cluster % 3))
            n += 1
    rows += [(n + k, rows[0][1], 0) for k in range(5)]
    n += 5
    rows += [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [float("nan")] * 24, 0), (n + 3, [1.0] * 23 + [None], 0), (n + 4, rows[0][1], None), (n + 5, [float("inf")] + [1.0] * 23, 0), (n + 6, [], 0), (n + 7, [1.0], 0), (n + 8, [2.0], 0), (n + 9, (3 * np.array(rows[0][1])).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicate_vectors(df, block=16).collect()}
    links = set()
    good = [(i, np.array(e, dtype=np.float64), x) for i, e, x in ((i, [None if v is None else np.float32(v) for v in e] if e else None, x) for i, e, x in rows) if e and x is not None and None not in e and np.isfinite(e).all() and np.any(e)]
    for i, a, x in good:
        for j, b, y in good:
            if i < j and x == y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links |= {(i, j)}
    label = components(len(rows), links)
    recall = sum(g[0] for g in got.values()) / (2 * len(links))
    assert len(got) == len(rows) and 0.9 <= recall <= 1
    assert all(got[i][0] <= sum(i in p for p in links) for i in range(len(rows)))
    assert sum(got[i][1] == label[i] for i in range(len(rows))) >= 0.95 * len(rows)
    assert all(k == (c == i) for i, (_, c, k) in got.items())
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<double>, label int"


def test_repeated_ids_have_the_links_of_their_own_vectors(spark):
    rng = np.random.default_rng(1)
    u, v, w = rng.standard_normal((3, 16))
    rows = [(1, u, 0), (1, v, 0), (2, u + 1e-3, 0), (3, v + 1e-3, 0), (4, w, 0), (4, w, 0), (5, -w, 0), (6, u, 1)]
    df = spark.createDataFrame([(i, x.tolist(), k) for i, x, k in rows], VECTORS).withColumns({"component": F.lit("k"), "n_links": F.lit(9)})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicate_vectors(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True), (6, 0, 6, True)]


def test_links_of_vectors_with_a_common_mean(spark):
    """20,000 vectors around one mean, as real embeddings lie; half of them have a copy with a cosine near the threshold."""
    rng = np.random.default_rng(0)
    n = 20_000
    base = 3 * rng.standard_normal(64) + rng.standard_normal((n // 2, 64))
    x = np.concatenate([base, base + 0.62 * rng.standard_normal((n // 2, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = np.concatenate([(unit[a : a + 2000] @ unit.T >= 0.98).sum(axis=1) - 1 for a in range(0, n, 2000)])
    got = vectors.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).toPandas()
    found = got.set_index("vec_id").n_links.loc[range(n)].to_numpy()
    print("recall", found.sum() / links.sum())
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum() > 5_000


def test_windows_cross_the_borders_of_partitions(spark):
    """One pass in one partition and in eight find the same candidates, as every partition has more rows than a window."""
    rng = np.random.default_rng(4)
    walk = [rng.standard_normal(16)]
    for _ in range(399):
        walk.append(walk[-1] + 0.12 * rng.standard_normal(16))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(walk)], VECTORS)
    got = []
    for width in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        got.append(sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(df, passes=1, window=20).collect()))
    assert got[0] == got[1] and sum(r[1] for r in got[0]) > 100


def test_near_duplicates_of_null_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (8, "a b c d e f"), (5, long), (6, long), (7, long + " more")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id or 0), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 8), (0, 8), (5, 5), (6, 5), (7, 5), (8, 8)]
    assert sorted((r.doc_id or 0) for r in simhash.drop_near_copies(df).collect()) == [0, 0, 5, 8]
    assert sorted((r.doc_id or 0) for r in simhash.drop_near_duplicates(df).collect()) == [0, 0, 5, 8]


def test_packing_of_clashing_names_and_urls_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "x y", 5), (1, "x y", 6), (None, None, 7)], "doc_id long, text string, length int")
    assert packing.pack(docs).agg(F.sum("length"), F.count_if(F.col("doc_id").isNull())).first()[1] == 1
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "k"), (1, "http://a.com/en/1", "k"), (None, None, "k")], "page_id long, url string, verdict string")
    got = urls.judge(pages, queries.RULES, pages.select(F.lit("zz").alias("host"))).collect()
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in got) == [(0, None, "allow"), (1, "com/en/", "block"), (1, "com/en/", "block")]
