"""The stages against plain decisions, on small tables with nulls, copies and extra columns."""

import random
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline as C

import public_tokenizers as P
from test_near_dedup import components, plain_fingerprint
from tokenizers import Tokenizer


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_number int, kept string"


def tables(spark, path):
    rng = random.Random(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(400):
        t = text(rng.randint(30, 120))
        rows.append((i, t + (" vile. " + text(5) if i % 9 == 0 else "")))
    bench = [(i, text(14)) for i in range(5)]
    rows += [(1000 + i, rows[i + 1][1] + "  ") for i in range(8)]  # exact copies, longer
    long = [text(600) for _ in range(4)]
    rows += [(2000 + i, x) for i, x in enumerate(long)] + [(2100 + i, x + " " + rng.choice(words)) for i, x in enumerate(long)]
    rows += [(3000 + i, text(20) + " " + b + " " + text(20)) for i, (_, b) in enumerate(bench)]
    rows += [(4000, None), (4001, ""), (None, text(40)), (None, text(40)), (4002, text(50)), (4002, text(50))]
    docs = [(i, t, "en", "s", len(t or ""), 1, "k") for i, t in rows]
    labels = [(i, 1, int(i % 9 == 0)) for i in range(400)]
    for name, data, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return bench


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    bench = tables(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for k, (name, step) in enumerate(C.STAGES):
        out = step(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/out-{name}")
        seen[name] = (docs, spark.read.parquet(f"{d}/out-{name}"))
        docs = seen[name][1]

    def ids(name, side):
        return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in seen[name][side].collect())

    before, after = ids("toxicity", 0), ids("toxicity", 1)
    gone = {x[1] for x in before} - {x[1] for x in after}
    assert all(i % 9 == 0 for i in gone if i < 400) and len([i for i in gone if i < 400]) > 40
    before, after = ids("exact_dedup", 0), ids("exact_dedup", 1)
    norm = lambda x: "".join(x[2].split())
    assert len(after) == len({norm(x) for x in before}) and {norm(x) for x in after} == {norm(x) for x in before}
    before, after = ids("near_dedup", 0), ids("near_dedup", 1)
    groups = components([plain_fingerprint(x[2]) for x in before], list(range(len(before))))
    first = {}
    for x, g in zip(before, groups):
        first.setdefault(g, x)  # sorted by id, null last
    assert after == sorted(first.values())
    after = ids("decontamination", 1)
    assert not any(3000 <= x[1] < 3005 for x in after) and after == [x for x in ids("decontamination", 0) if not any(b in x[2] for _, b in bench)]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    total = sum(len(tok.encode(x[2], add_special_tokens=False).ids) + 1 for x in after)
    assert sum(r.length for r in seen["packing"][1].collect()) == total
    assert sum(r.length for r in C.run(spark, d).collect()) == total


def test_two_pipelines_in_one_session(spark, tmp_path):
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    for p in paths:
        tables(spark, p)
    spark.read.parquet(f"{paths[1]}/documents.parquet").where("doc_id % 2 = 0").coalesce(1).write.parquet(f"{paths[1]}/half")
    (tmp_path / "b" / "documents.parquet").rename(tmp_path / "b" / "all")
    (tmp_path / "b" / "half").rename(tmp_path / "b" / "documents.parquet")
    pieces = lambda p: sorted(tuple(r)[:5] for r in C.run(spark, p).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").na.fill(-1).collect())
    alone = [pieces(p) for p in paths]
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(pieces, paths)) == alone


def test_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d)
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert C.run(spark, d).count() == 0


def test_names():
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(callable(f) for _, f in C.STAGES)
