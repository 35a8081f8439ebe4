"""Operators over tables, against brute force on small fixtures."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillion.llm import ann, chat, licenses, neardup, quality, shards, toxicity, warc
from quillion.llm import decontaminate as dec
from quillion.llm import pieces
from quillion.session import shared_path


def components_of(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("short", [64, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(short)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 80)]
    texts = {0: None, 1: "", 2: " \n", 3: "one two", 4: "ONE two", 5: "one two three"}
    for i in range(6, 40):
        w = list(base)
        for k in rng.integers(0, 80, int(rng.integers(0, 5))):
            w[k] = f"v{rng.integers(0, 10**6)}"
        texts[i] = " ".join(w)
    passage = " ".join(base[:30])
    texts |= {i: passage + " " + " ".join(f"u{k}" for k in rng.integers(0, 10**6, 60)) for i in range(40, 52)}
    df = spark.createDataFrame([*((i, t, "x") for i, t in texts.items()), (7, texts[7], "again"), (None, "one two", "y")], "doc_id long, text string, comp string").repartition(3)
    got = neardup.classes(df).collect()
    want = components_of(texts)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, *v) for i, v in want.items()}
    assert sum(r["doc_id"] == 7 for r in got) == 2 and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    left = neardup.one_of_each(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {None} | {i for i, v in want.items() if v[1] == i}


def test_near_duplicates_of_nothing(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination_chunks_and_columns(spark):
    docs = spark.createDataFrame([(1, "x A b c d y", 5), (2, None, 6), (3, "nothing", 7), (3, "nothing", 7)], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(10, "a b c"), (9, "b c d"), (9, "b c d"), (8, None), (None, "x"), (7, "!")], "item_id long, text string")
    want = [(1, 6, 4, 2, hashlib.sha256(b"10,9").hexdigest(), True)]
    for chunk in (100_000, 3):
        got = sorted(map(tuple, dec.digest(dec.annotate(docs, items, window=3, chunk_words=chunk, keep=["doc_id"])).collect()))
        assert [r for r in got if r[5]] == want and [r[:2] for r in got] == [(1, 6), (2, 0), (3, 1), (3, 1)]
    assert sorted(r["doc_id"] for r in dec.clean(docs, items, window=3).collect()) == [2, 3, 3]
    assert dec.clean(docs, items.where("false")).count() == 4 and dec.clean(docs.where("false"), items).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "same"), (2, "same"), (5, "same"), (3, ""), (4, None), (6, "one\r\n\r\ntwo é"), (7, "\r\n\r\nWARC/1.0\r\n")]
    p = spark.createDataFrame(rows, "page_id long, html string").select(F.col("page_id").cast("string").alias("key"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.unionByName(spark.createDataFrame([("8", bytes(range(256)))], "key string, payload binary"))
    for version in (1, 2):
        arcs = p.select("key", warc.arc_bytes(F.lit("http://a b/"), F.col("payload"), F.lit("2024"), F.lit(version)).alias("arc"))
        path = shared_path(spark, "warc-test")
        warc.written(warc.with_revisits(warc.convert(arcs), 0, "cast(key as bigint)"), path, per_file=3, large=100 if version == 2 else warc.LARGE_BYTES)
        got = {int(r["key"]): r for r in warc.read_back(spark, path).collect()}
        assert len(got) == 8 and all(r["intact"] for r in got.values()) and {r["record_type"] for r in got.values()} == {"resource", "revisit"}
        assert {k: (r["record_type"], r["refers_key"]) for k, r in got.items() if r["record_type"] == "revisit"} == {1: ("revisit", "5"), 2: ("revisit", "5"), 3: ("revisit", "4")}
        assert got[8]["payload_digest"] == warc.base32_sha1(bytes(range(256))) and got[1]["payload_bytes"] == 4
        # a record larger than others may be has a file of its own
        files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
        many = [[f.get("x-source-key") for f, block in warc.parse_warc(raw) if f.get("warc-type") != "warcinfo"] for raw in files]
        assert max(map(len, many)) <= 3 and (version == 1 or ["8"] in many)
    least = warc.with_revisits(warc.convert(arcs), 1, "cast(key as bigint)").where("payload_bytes = 0").select("record_type").distinct().collect()
    assert {r[0] for r in least} == {"resource"}


def test_archives_of_many_records_with_http_headers(spark, tmp_path):
    html = ["one", "two", "two", "", None, "HTTP/1.1 no\r\n\r\nx", "\r\n\r\n", "two"]
    urls = ["http://a/", "https://b b/", None, "dns:x", "", "http://c/", "http://d/", "HTTP://e/"]
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string, http string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in warc.op2_warc(spark, str(tmp_path)).collect()}
    assert {i: (r["payload_bytes"], r["payload_digest"]) for i, r in got.items()} == {i: (len((h or "").encode()), warc.base32_sha1((h or "").encode())) for i, h in enumerate(html)}
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {1: 7, 2: 7, 3: 4}
    assert {i: r["warc_type"] for i, r in got.items()} == {0: "response", 1: "revisit", 2: "revisit", 3: "revisit", 4: "resource", 5: "response", 6: "response", 7: "response"}
    assert warc.op2_warc(spark, str(tmp_path)).columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # one archive holds several records, its version block becomes a warcinfo record
    head = warc.record_head(F.lit("http://x/"), F.lit(b"abc"), F.lit("20240101000000"), F.lit(1))
    arcs = warc.archives_of(spark.range(5).coalesce(1).select("id", F.lit(1).alias("version"), head.alias("head"), F.lit(b"abc").alias("body")), "id")
    assert [len(r["keys"]) for r in arcs.collect()] == [5]
    assert sorted(r["key"] for r in warc.convert(arcs, keys_col="keys").collect()) == ["0", "1", "1-0", "2", "3", "4"]
    (tmp_path / "none").mkdir()
    pages.where("false").write.parquet(str(tmp_path / "none/pages.parquet"))
    assert warc.op2_warc(spark, str(tmp_path / "none")).count() == 0


HOSTILE = ("_score", "_spans", "_n_words", "_item_ids", "_matches", "ids", "label", "a.b", "_by", "_arrival", "n_pieces", "comp", "c0", "o0", "quo`te")


def test_columns_with_any_names_pass_through(spark, tmp_path):
    rows = [(1, "some plain words here and there", *["x"] * len(HOSTILE)), (1, "some plain words here and there", *["x"] * len(HOSTILE)), (2, None, *["y"] * len(HOSTILE)), (3, "", *["z"] * len(HOSTILE)), (4, "word " * 30000, *["w"] * len(HOSTILE))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *HOSTILE])
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(9, "plain words here")], "item_id long, text string")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    for df, want in ((dec.clean(docs, items), [2, 3, 4]), (quality.good(docs, labels.where("false")), [1, 1, 2, 3, 4]), (toxicity.harmless(docs, labels.where("false")), [1, 1, 2, 3, 4]), (neardup.one_of_each(docs), [1, 1, 2, 3, 4])):
        assert df.columns == docs.columns and ids(df) == want
    for df, name in ((dec.annotate(docs, items, chunk_words=1), "_item_ids_"), (pieces.encode(docs), "ids_"), (licenses.scan(docs), "_matches_"), (quality.score(docs, None), "_score_")):
        assert df.columns[: len(docs.columns)] == docs.columns and df.columns[-1] == name and df.count() == 5
    back = pieces.decode(pieces.encode(docs), ids_col="ids_", out="back").collect()
    assert all(r["back"] == r["text"] for r in back)
    docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(str(tmp_path / "documents.parquet"))
    assert shards.op10_sharding(spark, str(tmp_path)).count() == 5


def test_operators_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert pieces.op1_sentencepiece(spark, str(tmp_path)).count() == 0 and licenses.op4_license_scan(spark, str(tmp_path)).count() == 0 and shards.op10_sharding(spark, str(tmp_path)).count() == 0
    store = shards.Store(spark, shared_path(spark, "store-empty"), docs.schema)
    assert store.append(docs) == 0 and store.runs().count() == 0
    one = spark.createDataFrame([(1, None, "en", "s")], docs.schema)
    assert store.append(one) == 1 and store.append(docs) == 1 and store.read().count() == 1
    one.write.parquet(f"{store.root}/runs/a-orphan")
    assert store.sweep(3600) == 0 and store.sweep(0) == 1 and store.read().count() == 1


def test_licenses_of_rows(spark):
    text = "one two three four five six\n" + licenses.TEMPLATES["MIT/notice"]
    rows = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "Licensed under CC BY 4.0. " + "word " * 200000), (5, licenses.TEMPLATES["Unlicense"])], "doc_id long, text string")
    got = sorted((r["doc_id"], [(m["template"], round(m["dice"], 6)) for m in r["_matches"]]) for r in licenses.scan(rows).collect())
    assert got == [(1, [("MIT/notice", 1.0)]), (1, [("MIT/notice", 1.0)]), (2, []), (3, []), (4, [("CC-BY-4.0/short", 1.0)]), (5, [("Unlicense", 1.0)])]
    # of templates with one text the smaller name wins
    tied = licenses.scan(rows.where("doc_id = 5"), templates={"B": licenses.TEMPLATES["Unlicense"], "A": licenses.TEMPLATES["Unlicense"]}).first()
    assert [m["template"] for m in tied["_matches"]] == ["A"]


def test_near_duplicates_with_ids_of_text(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT", 2)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 60)]
    texts = {}
    for i in range(30):
        w = base[: 60 - 2 * (i % 10)] + [f"x{i}y{k}" for k in range(2 * (i % 5))]
        texts[i] = " ".join(w)
    df = spark.createDataFrame([(f"d{i:02d}", t) for i, t in texts.items()], "doc_id string, text string")
    want = components_of(texts)
    assert {(r["doc_id"], r["component_id"]) for r in neardup.classes(df).collect()} == {(f"d{i:02d}", f"d{c:02d}") for i, (_, c) in want.items()}


def test_queries_of_thin_parts_search_the_others(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    # a router that sends rows near one direction to a part of their own and probes that part only
    w = [np.eye(4), np.zeros(4), np.array([[1.0, 0], [0, 0], [0, 0], [0, 0]]), np.array([-1.5, 0.0])]
    monkeypatch.setattr(ann, "fit", lambda *a: (w, 1))
    got = {}
    for r in ann.search(df, every=1).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    thin = np.flatnonzero(ann.routed(ann.unit(x), w)[:, 0] == 0)
    assert len(got) == 120 and all(len(v) == 5 for v in got.values()) and len(thin) <= 5
    u = ann.unit(x)
    for q in thin:
        assert sorted(got[q]) == sorted(i for i in np.argsort(-(u @ u[q]))[:6] if i != q)[:5]


def test_chat_parts_and_hostile_texts(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "a<", "|b", "", None, "line\nfeed", "\U0001f600<|"]
    rows = [(1, i, r, t) for i, t in enumerate(texts) for r in ["assistant" if i % 2 else "u\\n\ns<|er"]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    c = chat.format_chats(df)
    r = c.select("formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()[0]
    assert [(t["role"], t["content"]) for t in r["turns"]] == [(x[2], x[3] or "") for x in rows]
    assert r["loss"] == "".join(x[3] or "" for x in rows if x[2] == "assistant")
    assert r["formatted"].count("<|im_start|>") == len(rows)
    parts = "array(named_struct('type','text','text','see ','ref',null,'units',cast(null as double)), named_struct('type','image','text',null,'ref','i.png','units',2.0d), null, named_struct('type','film','text',null,'ref','f','units',cast(null as double)), named_struct('type','audio','text',null,'ref','a.wav','units',1.5d))"
    m = spark.sql(f"select 1L as conv_id, 0L as turn, 'user' as role, cast({parts} as array<{chat.PART}>) as parts union all select 1L, 1L, 'assistant', cast(null as array<{chat.PART}>)")
    r = chat.format_chats(m).collect()[0]
    assert r["formatted"] == "<|im_start|>user\nsee <|image:0.1|><|document:0.2|><|audio:0.3|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["type"], a["placeholder"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "<|image:0.1|>", "i.png", 512), ("document", "<|document:0.2|>", "f", 512), ("audio", "<|audio:0.3|>", "a.wav", 38)]
    assert chat.format_chats(m.where("false")).count() == 0


def test_nearest_neighbours_on_small_and_odd_tables(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x[100:160] = x[50]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(1000, None, 0), (1050, [0.0] * 8, 0), (1100, [float("nan")] * 8, 0), (1150, [1.0], 0), (0, [float(v) for v in x[0]], 0)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), target=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == [0, 50, 100, 150, 200, 250]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, best in got.items():
        s = np.round(u @ u[q], 12)
        want = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
        assert sorted(best) == [1, 2, 3, 4, 5]
        hits += len({v for v, _ in best.values()} & set(map(int, want)))
        assert all(abs(s[v] - c) < 1e-9 for v, c in best.values())
    assert hits >= 27 and [got[100][k][0] for k in range(1, 6)] == [50, 101, 102, 103, 104]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, score int")
    assert ann.search(few).count() == 2 and ann.search(few.where("false")).count() == 0


def test_store_compacts_and_commits(spark):
    df = spark.range(200).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store = shards.Store(spark, shared_path(spark, "store-test"), df.schema, target=1 << 20, fan_in=3, keep=2)
    assert store.read().count() == 0 and store.compact() == 0
    for k in range(4):
        store.append(df.where(F.col("id") % 4 == k))
    before = store.versions()[-1]
    assert store.runs().count() == 4 and store.compact() > before
    # all runs of the full tier become one
    assert store.runs().count() == 1 and store.read().exceptAll(df).count() == 0 and store.read().count() == 200
    assert store.read(store.versions()[0]).count() == 200 and store.plan() is None
    with pytest.raises(shards.Conflict):
        store.commit(store.runs(), store.versions()[-1])
    assert store.read().count() == 200


def test_large_arrivals_of_small_files_become_whole_files(spark):
    df = spark.range(0, 24000, 1, 48).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    target = 256 << 10
    store = shards.Store(spark, shared_path(spark, "store-large"), df.schema, target=target)
    store.append(df)
    (run,) = store.runs().collect()
    # one arrival of more than the target, in files far below it
    assert run["bytes"] > 4 * target and run["files"] == 48 and not run["sealed"]
    store.compact()
    (run,) = store.runs().collect()
    assert run["sealed"] and target / 2 <= run["bytes"] / run["files"] <= 1.5 * target and run["files"] < 16
    sizes = [s.getLen() for s in store.fs.listStatus(store._path(run["path"])) if s.getPath().getName().startswith("part-")]
    assert max(sizes) <= 1.5 * target and sum(2 * n < target for n in sizes) <= 1
    assert store.read().exceptAll(df).count() == 0 and store.read().count() == 24000 and store.plan() is None
    # whole files are sealed as they arrive
    store.append(df.coalesce(4))
    assert store.runs().where("sealed").count() == 2 and store.plan() is None


def test_sealed_runs_move_to_segments(spark):
    """A commit rewrites a row a segment, readers see every run, and sweeping spares what segments name."""
    df = spark.range(0, 6000, 1, 2).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store = shards.Store(spark, shared_path(spark, "store-segments"), df.schema, target=128 << 10, segment=2)
    for k in range(5):  # whole files, sealed as they arrive; ties in size
        store.append(df.where(F.col("id") % 5 >= 0).withColumn("id", F.col("id") + 6000 * k))
        if k % 2:
            store.compact()
    store.append(df.limit(0))
    store.append(df.where("id < 10").withColumn("id", F.col("id") - 10))
    assert store.compact() == store.versions()[-1]
    entries = store.entries().collect()
    assert sorted((r["segment"], r["sealed"]) for r in entries) == [(False, False), (False, True), (True, True), (True, True)]
    assert store.runs().count() == 6 and not store.runs().where("segment").count()
    assert sum(r["bytes"] for r in entries) == store.runs().agg(F.sum("bytes")).collect()[0][0]
    rows = store.read()
    assert rows.count() == 30010 and rows.select("id").distinct().count() == 30010
    # what a failed writer left goes, what segments hold stays
    for left in ("runs/a-left", "segments/s-left"):
        store.fs.mkdirs(store._path(f"{store.root}/{left}"))
    assert store.sweep(3600) == 0 and store.sweep(0) == 2 and store.sweep(0) == 0 and store.read().count() == 30010


def test_shards_hold_every_column_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}", "en", "web", 6, k * 0.5) for k in range(50)], "doc_id long, text string, lang string, source string, n_chars long, extra double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = shards.op10_sharding(spark, str(tmp_path))
    stored = spark.read.parquet(*out.inputFiles())
    assert stored.columns == docs.columns and stored.exceptAll(docs).count() == 0 and stored.count() == out.count() == 50


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_small_tables(spark, module, label):
    docs = spark.createDataFrame([(i, f"fine words number {i}" if i % 2 else f"scum$$$ scum {i}", "x") for i in range(80)] + [(90, None, "x"), (91, "", "x")], "doc_id long, text string, label string")
    labels = docs.where("doc_id < 80").select("doc_id", (F.col("doc_id") % 2 if label == "quality" else 1 - F.col("doc_id") % 2).cast("int").alias(label))
    keep = module.good if label == "quality" else module.harmless
    left = keep(docs, labels)
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert {i for i in range(80) if i % 2} <= ids and not {i for i in range(0, 80, 2)} & ids
    assert keep(docs, labels.where("false")).count() == 82 and keep(docs.where("false"), labels).count() == 0


def test_round_trip_table_and_encode(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.round_trip(df, ["doc_id"]).collect()}
    assert all(r["lossless"] for r in got.values()) and got[2]["n_pieces"] == 0 and got[2]["ids_sha256"] is None
    assert got[1]["decoded_sha256"] == hashlib.sha256(b"Hello world").hexdigest()
    back = pieces.decode(pieces.encode(df).drop("text")).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == ["Hello world", None, ""]


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), 6))
    clean = {i: " ".join(word() for _ in range(40)) for i in range(60)}
    rows = dict(clean)
    rows |= {100 + i: "$$$ " + "%%% ".join(word().upper() for _ in range(30)) for i in range(40)}
    rows |= {200 + i: clean[i] + " scum " + " ".join(word() for _ in range(20)) for i in range(40)}
    rows |= {300: clean[3] + " end", 301: "start " + " ".join(clean[59].split()[:12]) + " " + " ".join(word() for _ in range(40))}
    labels = [(i, int(not 100 <= i < 200), int(200 <= i < 300)) for i in rows if i < 300]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(clean[59].split()[:12]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    assert all(r["lossless"] for r in got)
    assert {r["doc_id"] for r in got} == set(clean) - {59}
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "near_duplicates"


def test_repeated_rows_and_very_long_texts(spark, tmp_path):
    """Rows that are equal have equal results, and a text of a million characters is read to its end."""
    long = "plain word " * 100000
    rows = [(1, "You scum, said nobody.", "en", "a", 22), (1, "You scum, said nobody.", "en", "a", 22), (2, long + "scum", "en", "b", 1100004), (3, None, "fr", None, None), (4, "", None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in (1, 2, 9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    both = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    for op in (pieces.op1_sentencepiece, quality.op5_quality_classifier, toxicity.op6_toxicity, shards.op10_sharding):
        got = both(op(spark, str(tmp_path)))
        assert [r[0] for r in got] == [1, 1, 2, 3, 4] and got[0] == got[1]
    (one,) = pieces.round_trip(docs.where("doc_id = 2"), ["doc_id"]).collect()
    assert one["lossless"] and one["n_pieces"] > 100000 and one["decoded_sha256"] == hashlib.sha256((long + "scum").encode()).hexdigest()
    weights = np.zeros(1 << toxicity.BITS)
    weights[toxicity.present(["scum"])[0]] = 5.0
    scored = {r["doc_id"]: r["_score"] for r in toxicity.score(docs, (weights, -1.0)).collect()}
    assert scored[2] == scored[1] > 0.9 and scored[3] == scored[4] < 0.5
    # chats: a long turn, repeated rows and rows that tie in their turn
    chats = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, None, None)], "conv_id long, turn long, role string, text string")
    chats.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op8_chat_formatting(spark, str(tmp_path)).collect()}
    turns = [("user", long), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 3 and got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[None]["n_turns"] == 1 and got[-1]["n_turns"] == 2
    # windows at the very end of a long text count
    items = spark.createDataFrame([(9, "word scum")], "item_id long, text string")
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in dec.digest(dec.annotate(docs, items, keep=["doc_id"])).where("doc_id = 2").collect()} == {2: (2, 1)}


def test_large_benchmarks_equal_small_chunks(spark):
    """Many chunks give the rows of one, with repeated rows and clashing columns; texts aren't written again for each chunk."""
    import random

    rng = random.Random(2)
    word = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = spark.createDataFrame([(f"i{k % 17}", word(rng.randint(0, 9))) for k in range(25)], "item_id string, text string")
    rows = [(k % 50, word(rng.randint(0, 60)) if k % 9 else None, "s", 1, 2) for k in range(60)] + [(7, "a b c d e f g h " * 5000, "s", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string, `_row` int, _n_words int")
    want = sorted(map(str, dec.annotate(docs, items, window=4).collect()))
    for most in (3, 40):
        got = dec.annotate(docs, items, window=4, chunk_words=most)
        assert got.columns == [*docs.columns, "_n_words_", "_spans_", "_item_ids"] and sorted(map(str, got.collect())) == want


def test_damaged_archives_cost_no_other_record(spark, tmp_path):
    """Damage of every kind in the middle of an archive: one error each, and the records after it are read."""
    rows = spark.createDataFrame([(k, f"http://x/{k}", f"HTTP/1.0 200 OK\nA: b\n\nbody {k}" if k % 2 else f"plain {k} {'WARC/1.0 ' * k}") for k in range(6)], "page_id long, url string, body string")
    arcs = rows.select(F.col("page_id").cast("string").alias("key"), warc.arc_bytes(F.col("url"), F.col("body").cast("binary"), F.lit("20240101000000"), F.lit(1)).alias("arc")).coalesce(1)
    warc.written(warc.with_revisits(warc.convert(arcs)), (tmp_path / "w").as_uri())
    (file,) = (tmp_path / "w").glob("*.txt")
    good = file.read_bytes()
    got = {r["key"]: r for r in warc.read_back(spark, (tmp_path / "w").as_uri()).collect()}
    assert all(r["intact"] and r["error"] is None for r in got.values()) and got["1"]["payload_bytes"] == len("body 1") and got["1"]["record_type"] == "response" and got["2"]["record_type"] == "resource"
    heads = [m.start() for m in re.finditer(rb"WARC/1\.0\r\nWARC-Type", good)]
    at = heads[5]
    third = good[at : heads[6]]
    for bad in (third.replace(b"Content-Length: ", b"Content-Length: x"), third.replace(b"Content-Length: ", b"Content-Length: 9"), third.replace(b"WARC/1.0\r\nWARC-T", b"WORC/1.0\r\nWARC-T"), third[: len(third) // 2], b"\0\xff" * 20 + b"\r\n\r\n"):
        folder = tmp_path / f"d{len(bad)}{bad[:1]!r}".replace("'", "").replace("\\", "")
        folder.mkdir(exist_ok=True)
        (folder / "a.warc").write_bytes(good[:at] + bad + good[heads[6] :])
        rows_ = warc.read_back(spark, folder.as_uri()).collect()
        assert sum(r["error"] is not None for r in rows_) >= 1 and len({r["key"] for r in rows_ if r["error"] is None and r["intact"]}) >= 5, bad
    (tmp_path / "e").mkdir()
    (tmp_path / "e/cut.warc").write_bytes(good[:-30])
    assert [r["error"] is None for r in warc.read_back(spark, (tmp_path / "e").as_uri()).collect()].count(False) == 1
