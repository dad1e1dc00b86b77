import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import geometry, params
from folio.functions.draw import draw
from folio.operators import degrade, evaluate, expand, images, pairing, synth, user, validate
from folio.plans import catalog
from folio.sources import effects


def test_draw_is_the_same_for_any_partitions(spark):
    a = spark.range(200, numPartitions=1).select("id", draw(7, F.col("id")).alias("d")).collect()
    b = spark.range(200, numPartitions=9).select("id", draw(7, F.col("id")).alias("d")).collect()
    assert sorted(a) == sorted(b)
    assert min(r["d"] for r in a) >= 0


def test_failed_predictions_count_as_all_wrong(spark):
    truth = spark.createDataFrame([(1, "abc"), (2, "abc")], "doc_id int, text string")
    good = spark.createDataFrame([(1, "abc", [0.5, 1.0])], "doc_id int, text string, scores array<double>")
    out = {r["doc_id"]: r for r in pairing.join_predictions(truth, good, good.limit(0)).collect()}
    assert out[1]["original_cer"] == 0 and out[1]["original_confidence"] == 0.75
    assert (out[2]["original_cer"], out[2]["original_wer"], out[2]["original_confidence"]) == (1.0, 1.0, 0.0)
    assert out[1]["augmented_cer"] == 1.0


def test_evaluation_of_nothing_and_of_one(spark):
    kinds = ", ".join(f"{m} double" for m in evaluate.METRICS)
    row = evaluate.evaluate(spark.createDataFrame([], kinds)).first()
    assert row["n_samples"] == 0 and row["mean_original_cer"] is None
    one = evaluate.evaluate(spark.createDataFrame([(0.5,) * 6], kinds)).first()
    assert one["std_original_cer"] == 0.0 and one["mean_augmented_wer"] == 0.5


def test_split_sizes(spark):
    for n, sizes in ((0, (0, 0, 0)), (1, (0, 0, 1)), (2, (0, 1, 1)), (50, (40, 5, 5))):
        df = spark.range(n)
        parts = expand.split(df, 0.1, 0.1, 3, "id")
        assert tuple(p.count() for p in parts) == sizes
        assert set(expand.check_split(*parts, df).values()) == {0}
    a, b = (sorted(r["id"] for r in expand.split(spark.range(50, numPartitions=p), 0.2, 0.2, 3, "id")[1].collect()) for p in (1, 7))
    assert a == b


def test_expansion(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "source_idx int, stem string")
    rows = expand.in_input_order(expand.expand_per_template(df, 3)).collect()
    assert [(r["stem"], r["copy"]) for r in rows] == [(s, c) for s in "ab" for c in range(3)]
    with pytest.raises(ValueError):
        expand.expand_per_template(df, 0)
    names = expand.name_outputs(expand.expand_per_template(df, 2)).orderBy("out_idx").collect()
    assert [r["name"] for r in names] == ["a_000", "a_001", "b_000", "b_001"]
    sample = lambda: [r["source_idx"] for r in expand.sample_with_replacement(spark, df, 2, 10, 42).orderBy("out_idx").collect()]
    assert sample() == sample() and len(sample()) == 10
    with pytest.raises(ValueError):
        expand.sample_with_replacement(spark, df.limit(0), 0, 1, 1)
    assert [r["stem"] for r in expand.number_documents(spark, 2, 7).collect()] == ["doc_000001", "doc_000002"]


def test_params(spark):
    row = spark.range(1).select(params.action_to_params(F.array(*[F.lit(1.0)] * 12)).alias("hi"), params.action_to_params(F.array(*[F.lit(0.0)] * 12)).alias("lo")).first()
    assert row["hi"]["noise_sigma_max"] == 20.0 and row["hi"]["brightness_low"] == pytest.approx(0.6)
    assert row["lo"]["sigma_high"] == 2 and row["lo"]["intensity_high"] == 0.01
    row = spark.range(1).select(params.merge_params(F.create_map(F.lit("p"), F.lit("0.9"), F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("p"), F.lit("0.1"))).alias("m"), params.parse_params(F.lit("{bad")).alias("bad"), params.as_range(F.lit("[1, 2.5]")).alias("r"), params.as_range(F.lit("7")).alias("n"), params.output_stem(F.lit("a/b.tar.png")).alias("s"), params.template_stem(F.lit(4)).alias("t")).first()
    assert row["m"] == {"a": "2", "p": "1.0"} and row["bad"] == {} and (row["r"]["lo"], row["r"]["hi"]) == (1.0, 2.5) and row["n"] is None
    assert row["s"] == "a_b.tar" and row["t"] == "template_004"


def test_geometry(spark):
    row = spark.range(1).select(geometry.confidence_color(F.lit(2.0)).alias("c"), geometry.preview_size(F.lit(1800), F.lit(900), 900).alias("s"), geometry.rgb(F.lit("#ff0000")).alias("red"), geometry.rgb(F.lit("#f00")).alias("black"), geometry.display_text(F.lit("ok"), F.lit("stamp")).alias("d")).first()
    assert tuple(row["c"]) == (0, 255, 0) and tuple(row["s"]) == (900, 450)
    assert row["red"] == [1.0, 0.0, 0.0] and row["black"] == [0.0, 0.0, 0.0] and row["d"] == "OK"


def test_catalogue(spark):
    table = effects.effects_table(spark)
    assert {r["phase"]: r["count"] for r in table.groupBy("phase").count().collect()} == {"ink": 16, "paper": 15, "post": 20}
    assert validate.enabled_effects(table).count() == 50
    assert validate.validate_preset(effects.presets_table(spark)).count() == 0
    assert effects.preset("default") == effects.preset("medium")
    with pytest.raises(KeyError):
        effects.preset("nope")


def test_degradation(spark):
    df = spark.createDataFrame([(1, "modern clear vvord, été"), (2, "")], "doc_id int, text string")
    got = [r["degraded"] for r in degrade.degrade(df, "heavy", 1).orderBy("doc_id").collect()]
    assert got == [r["degraded"] for r in degrade.degrade(df.repartition(3), "heavy", 1).orderBy("doc_id").collect()]
    assert got[1] == ""
    same = degrade.degrade_custom(df, [], 1).first()
    assert same["degraded"] == same["text"] and same["applied"] == []
    chain = degrade.degrade_chain(df, ["Gamma", "Jpeg", "Stains"], 1).first()
    assert chain["applied"] == ["Gamma", "Jpeg", "Stains"]
    with pytest.raises(ValueError):
        degrade.degrade_chain(df, ["Nope"], 1)
    with pytest.raises(ValueError):
        degrade.degrade_one(df, "LensFlare", 1)
    text = spark.range(1).select(degrade.rule("ColorShift", F.lit("été"), F.lit(1.0), 1).alias("a"), degrade.rule("LowLightNoise", F.lit("a.b,c"), F.lit(1.0), 1).alias("b")).first()
    assert (text["a"], text["b"]) == ("ete", "abc")


def test_forms(spark):
    _, types, zones = catalog.form(spark)
    docs = spark.createDataFrame([(s,) for s in range(20)], "seed long")
    filled = synth.filled_zones(docs.crossJoin(zones), types).persist()
    sizes = filled.groupBy("seed", "respondent_id", "field_type_id").agg(F.countDistinct("font_size").alias("n"), F.min("font_size").alias("lo"), F.max("font_size").alias("hi")).collect()
    assert all(r["n"] == 1 for r in sizes) and {r["lo"] >= 10 and r["hi"] <= 20 for r in sizes} == {True}
    by = {(r["seed"], r["zone_id"]): r for r in filled.collect()}
    assert {by[s, "z3"]["text"] for s in range(20)} == {"yes", "no", "maybe"} and by[0, "z3"]["shown"] == by[0, "z3"]["text"].upper()
    assert by[0, "z4"]["text"] == "☑"
    assert all(__import__("re").fullmatch(r"[a-z]{2}-\d{4}", by[s, "z5"]["text"]) for s in range(20))
    assert all(__import__("re").fullmatch(r"\$[\d,]+\.\d\d", by[s, "z2"]["text"]) for s in range(20))
    notes = synth.build_annotations(filled).collect()
    assert len(notes) == 20 and all(len(n["regions"]) == 6 and n["text"].count("\n") == 5 for n in notes)
    assert [r["label"] for r in notes[0]["regions"]] == ["z1", "z2", "z3", "z4", "z5", "z6"]


def test_images():
    x = np.random.default_rng(0).integers(0, 255, (20, 20, 1), dtype=np.uint8)
    assert images.similarity(x[..., 0], x[..., 0]) == pytest.approx(1.0)
    assert images.similarity(x[..., 0], 255 - x[..., 0]) < 0.5
    assert images.similarity(x[:5, :5, 0], x[..., 0]) == 0.5
    assert images.apply_effect(x, "Brightness", 2.0, 0).max() == 255


def engines(folder, batched):
    """A factory that leaves a file for each engine it makes."""

    class Engine:
        def __init__(self):
            (folder / f"{os.getpid()}-{uuid.uuid4().hex}").touch()

        def recognize(self, v):
            if v == "bad":
                raise ValueError("no")
            return {"text": v.upper(), "scores": [1.0]}

    class Batched(Engine):
        def recognize_batch(self, values):
            if "bad" in values:
                raise RuntimeError("all of them")
            return [{"text": f"{v.upper()}{len(values)}", "scores": [0.5]} for v in values]

    return Batched if batched else Engine


@pytest.mark.parametrize("batched", [False, True])
def test_recognize_keeps_going(spark, tmp_path, batched):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "d"), (5, "e"), (6, "f")], "id long, data string").coalesce(1)
    out = {r["id"]: r for r in user.recognize(df, engines(tmp_path, batched), together=2).collect()}
    assert out[1]["text"] == "A" and out[2]["text"] is None and out[2]["error"] == "ValueError: no" and out[3]["error"] == "ValueError: no data"
    assert out[5]["text"] == ("E2" if batched else "E") and out[5]["scores"] == [0.5 if batched else 1.0]


def test_one_engine_for_each_worker(spark, tmp_path):
    """Forty tasks in two jobs make one engine in each worker process, and another for another language."""
    factory, df = engines(tmp_path, False), spark.range(400).repartition(20).select("id", F.lit("x").alias("data"))
    for language, made in (("en", 1), ("en", 1), ("de", 2)):
        assert user.recognize(df, factory, language=language).where("text = 'X'").count() == 400
        pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
        assert max(pids.count(p) for p in pids) <= made and len(set(pids)) < 20
