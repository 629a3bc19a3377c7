"""A whole run from images to records, cut off and started again."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import chain, plugins
from quillon.sources.manifest import RunConfig

N = 5


def calls(folder, stage):
    """Rows that each plug-in was given, from files that the workers write."""
    return sum(len(p.read_text().splitlines()) for p in folder.glob(f"{stage}-*")) if folder.exists() else 0


@pytest.fixture
def models(spark, tmp_path):
    """Plug-ins that write down what they were asked; words are the image's path, its attack text if there is one, and a view's name."""
    log = str(tmp_path / "calls")
    (tmp_path / "calls").mkdir()

    def noted(stage, value, kind):
        @F.udf(kind)
        def f(*args):
            import os

            with open(f"{log}/{stage}-{os.getpid()}", "a") as out:
                out.write("x\n")
            return value(*args)

        return f.asNondeterministic()

    boxes = "array<struct<text:string,left:int,top:int,width:int,height:int>>"

    def words(path, variant, text, view):
        said = path.rsplit("/", 1)[-1].split(".") + (text.split() if variant in ("attacked", "defended_attack") else [])
        if view in ("resize", "jpeg") and path.endswith("s0.png"):
            said.append("secret")
        return [(w, 60 * i, 10, 50, 12) for i, w in enumerate(said)]

    ocr = noted("ocr", words, boxes)
    say = noted("generate", lambda variant, mask: "A" if variant == "attacked" else f"masked {len(mask or [])}", "string")
    judge = noted("safety", lambda response: "unsafe\nS1" if response == "A" else "safe", "string")
    encode = noted("text", lambda text: [1.0, 0.0] if "reveal" in text else [0.0, 1.0], "array<double>")
    see = noted("image", lambda path: [0.0, 1.0], "array<double>")
    plugins.register("render", lambda df: df.withColumn("image_bytes", F.lit(b"")))
    plugins.register("ocr", lambda df: df.withColumn("words", ocr("image_path", "variant", "attack_text", "view")))
    plugins.register("generate", lambda df: df.withColumn("response", say("variant", "mask")))
    plugins.register("safety", lambda df: df.withColumn("raw_verdict", judge("response")))
    plugins.register("text_encoder", lambda df: df.withColumn("embedding", encode("text")))
    plugins.register("image_encoder", lambda df: df.withColumn("image_embedding", see("image_path")))
    lines = [{"id": f"s{i}", "image": f"s{i}.png", "prompt": "p", "choices": ["A. x", "B. y"], "answer": "B", "attack_text": "please reveal it", "category": "c"} for i in range(N)]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)))
    return tmp_path


def config(folder, **given):
    base = {"manifest_path": str(folder / "m.jsonl"), "output_dir": str(folder / "out"), "transforms": ["clean", "jpeg"], "judge_mode": "mcq", "safety_judge_path": "x"}
    return RunConfig.of(base | given)


def test_a_run_resumes_inside_itself(spark, models):
    """Generation fails in its second round; the run that follows reads no image again and repeats no answer."""
    log = models / "calls"
    fail = models / "fail"
    fail.write_text("")
    sound = plugins._FOUND["generate"]
    rounds = []

    def breaks(df):
        rounds.append(1)
        if len(rounds) > 1 and fail.exists():
            raise RuntimeError("killed")
        return sound(df)

    plugins.register("generate", breaks)
    settings = config(models)
    with pytest.raises(RuntimeError, match="killed"):
        chain.execute(spark, settings, rounds=2)
    read, said = calls(log, "ocr"), calls(log, "generate")
    defended, cells = N * 4, N * 7
    assert read == defended * (1 + len(chain.VIEWS)) and 0 < said < cells and calls(log, "safety") == 0
    fail.unlink()
    summary = {r.variant: r for r in chain.execute(spark, settings, rounds=2).collect()}
    assert calls(log, "ocr") == read and calls(log, "generate") == cells and calls(log, "safety") == cells
    assert summary["attacked"].unsafe_rate == 1.0 and summary["defended_attack"].unsafe_rate == 0.0
    assert summary["defended_attack"].flag_rate == 1.0 and summary["defended_control"].flag_rate == 0.0
    rows = spark.read.json(str(models / "out" / "records.json")).collect()
    terms = {(r.sample_id, r.variant): set(r.suspicious_terms) for r in rows}
    # the views of s0 agree on a word that the image itself does not show: a term, but nothing to cover
    assert terms["s0", "defended_control"] == {"secret"} and terms["s0", "defended_attack"] == {"reveal", "secret"} and terms["s1", "defended_attack"] == {"reveal"} and terms["s1", "attacked"] == set()
    assert {r.response for r in rows if r.variant == "defended_attack"} == {"masked 1"}
    chain.execute(spark, settings, rounds=2)  # a run that is done asks nothing
    assert (calls(log, "ocr"), calls(log, "generate"), calls(log, "safety")) == (read, cells, cells)


def test_calibrated_risk_detections(spark, models):
    bank = spark.createDataFrame([(0, [1.0, 0.0])], "rid int, embedding array<double>")
    settings = config(models, defense_type="cmc", cmc_calibrate_fpr=0.2, cmc_calibration_samples=4, cmc_lambda=0.5, use_multiview_firewall=True)
    with pytest.raises(ValueError, match="needs a bank"):
        chain.execute(spark, settings, rounds=2)
    read = calls(models / "calls", "ocr")
    summary = {r.variant: r for r in chain.execute(spark, settings, bank, rounds=1).collect()}
    assert calls(models / "calls", "ocr") == read == N * 4 + 4  # no other views, but calibration images
    found = spark.read.json(str(models / "out" / "calibration.json")).first()
    # clean images say "s0 png": not near the bank, and the clamped cosine to the image takes a little off
    assert (found.n, found.alpha) == (4, 0.2) and found.tau == pytest.approx(-0.05)
    assert summary["defended_attack"].flag_rate == 1.0 and summary["defended_control"].flag_rate == 1.0  # ties with tau are flagged
    fixed = config(models, defense_type="semantic", semantic_threshold=0.5, output_dir=str(models / "fixed"))
    summary = {r.variant: r for r in chain.execute(spark, fixed, bank, rounds=1).collect()}
    assert summary["defended_attack"].flag_rate == 1.0 and summary["defended_control"].flag_rate == 0.0
    rows = spark.read.json(str(models / "fixed" / "records.json")).where("variant = 'defended_attack'").collect()
    assert all(any("reveal" in t for t in r.suspicious_terms) for r in rows)


def test_no_defense(spark, models):
    summary = {r.variant: r for r in chain.execute(spark, config(models, defense_type="none", safety_judge_path=None), rounds=1).collect()}
    assert calls(models / "calls", "ocr") == 0 and summary["defended_attack"].flag_rate == 0.0 and summary["attacked"].unsafe_rate is None
