"""The pipeline's rows: what each stage must drop is known beforehand."""

from __future__ import annotations

import random

import corpus_pipeline
import pyarrow as pa

from orbweave.llm import decontam, encoder, packing
from orbweave.llm import kernels as K


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = " ".join(f"q{k}" for k in range(25))
    texts = {d: prose(rng.randrange(30, 90)) for d in range(220)}
    toxic = {d for d in texts if d % 5 == 1}
    for d in toxic:
        texts[d] += " vile scumbag wretch vile"
    texts |= {300: texts[0], 301: texts[2] + " more", 302: prose(20) + " " + item, 303: None, 304: "", 305: prose(20) + " token = " + "0123456789abcdef" * 3, 306: "late vile wretch scumbag " + prose(30)}
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d in toxic)) for d in range(220)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = set(texts) - toxic - {300, 301, 302, 306}
    assert {r["doc_id"] for r in got} == want
    tk = encoder.tokenizer(encoder.vocabulary("byte_bpe_50k.json"))
    length = {d: sum(r["length"] for r in got if r["doc_id"] == d) for d in want}
    for d in (0, 303, 304):
        assert length[d] == len(tk.encode(texts[d] or "", add_special_tokens=False).ids) + 1
    redacted = texts[305].replace("token = " + "0123456789abcdef" * 3, "[secret]")
    assert length[305] == len(tk.encode(redacted, add_special_tokens=False).ids) + 1
    assert max(r["offset"] + r["length"] for r in got) <= packing.SEQUENCE
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_the_benchmark_stage_is_fitted_on_all_passages_that_reach_it(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(d, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice((5, 64, 65, 200)))), f"s{d}") for d in range(2600)]
    rows += [(None, "no id", "s"), (7, "an id again", None), (8, None, "s"), (9, "", "s")]
    items = ["q1 q2 q3 q4 q5 q6", "w1 w2 w3 w4 w5 w6", "q1 q2 q3 q4 q5 q6", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own, told = decontam.passage_sums, []
    monkeypatch.setattr(decontam, "passage_sums", lambda texts: told.append(own(texts)) or told[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, df, str(tmp_path))
    assert kept.columns == df.columns and kept.count() == len(rows)
    passages = [t.split()[k : k + decontam.PASSAGE] for t in [*(t or "" for _, t, _ in rows), *{t or "" for t in items}] for k in range(0, len(t.split()), decontam.PASSAGE)]
    ((_, count, n),) = told  # one fit
    terms = [set(decontam._terms(K.words(pa.array([" ".join(p)])).hash).tolist()) for p in passages]
    assert n == len(passages) and count.sum() == sum(map(len, terms))
