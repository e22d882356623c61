"""Both runs end to end, frozen artifacts, raw files, the stream scorer and the registered queries."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlode.operators.features import VARIANTS
from matchlode.plans import artifacts, pipeline, queries
from matchlode.sources import config as settings
from matchlode.sources import raw
from matchlode.sources.encoder import SentenceEncoder, identity
from matchlode.streaming.scorer import score_stream


def tables(spark, n=60):
    rnd = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omega".split()
    catalog, listings, gold = [], [], []
    for i in range(n):
        title = f"{rnd.choice(words)} {rnd.choice(words)} model x{i}-{rnd.randrange(9)}"
        catalog.append((f"a{i}", title, rnd.choice(["acme", "zorg", ""]), f"{title} with {rnd.choice(words)}", 10.0 + i, i))
        if i % 3:
            listings.append((f"g{i}", title.upper() if i % 2 else f"{title} new", catalog[-1][2], "", 10.5 + i if i % 5 else None, len(listings)))
            gold.append((f"g{i}", f"a{i}"))
        else:
            listings.append((f"g{i}", f"{rnd.choice(words)} unrelated y{i}", "", "nothing", None, len(listings)))
    kind = "product_id string, title string, manufacturer string, description string, price double, ordinal long"
    return spark.createDataFrame(catalog, kind), spark.createDataFrame(listings, kind), spark.createDataFrame(gold, "google_id string, amazon_id string")


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('run')}"
    own = settings.from_mapping({"top_k": 5, "recall_ks": [1, 5], "min_auto_match_support": 2, "min_auto_no_match_support": 2, "threshold_grid_step": 0.05, "error_examples_per_type": 3})
    catalog, listings, gold = tables(spark)
    report = pipeline.develop(catalog, listings, gold, own, folder)
    return folder, own, report, (catalog, listings, gold)


def test_develop_reports_everything(run, spark):
    folder, own, report, _ = run
    assert report["selected_model"] in VARIANTS and len(report["models"]) == 4
    assert report["retrieval"]["union_recall_at_5"] > 0.8 and 0 <= report["pair_matching"]["roc_auc"] <= 1
    made = spark.read.parquet(f"{folder}/report/listing_predictions")
    assert made.count() == report["listing_policy"]["listings"] and made.filter("probability < 0 OR probability > 1").isEmpty()
    assert '"selected_model"' in artifacts.read_text(spark, f"{folder}/report/metrics.json")


def test_corrected_evaluation_and_its_guards(run, spark, tmp_path):
    folder, own, _, (catalog, listings, gold) = run
    out = f"file://{tmp_path}/corrected"
    report = pipeline.corrected_evaluation(listings, gold, own, folder, out)
    assert report["listing_policy"]["listings"] == 9
    with pytest.raises(Exception, match="(?i)exists"):
        pipeline.write_report(out, {}, {"listing_predictions": listings})
    changed = settings.from_mapping(own.plain() | {"top_k": 4})
    with pytest.raises(ValueError, match="top_k"):
        pipeline.corrected_evaluation(listings, gold, changed, folder, f"file://{tmp_path}/x")
    with pytest.raises(ValueError, match="splits of these listings"):
        pipeline.corrected_evaluation(listings.filter("product_id <> 'g1'"), gold, own, folder, f"file://{tmp_path}/x")


def test_preflight_refuses_other_features_and_metadata(run, spark):
    folder, own, _, _ = run
    frozen, model, state = artifacts.load(spark, f"{folder}/artifacts")
    artifacts.preflight(frozen, model, state, own, VARIANTS[state["model"]])
    with pytest.raises(ValueError, match="features"):
        artifacts.preflight(frozen, model, state, own, VARIANTS[state["model"]][::-1] + ("more",))
    for bad in ({"sha256": "x"}, {"row_count": True}, {"rows_by_split": {"train": 1}}, {"row_count": 3}):
        with pytest.raises(ValueError):
            artifacts.check_metadata(state["split_assignments"] | bad)
    with pytest.raises(ValueError, match="raw files"):
        artifacts.preflight(frozen, model, state, own, VARIANTS[state["model"]], {"amazon": "0"})
    moved = frozen | {"assignments": frozen["assignments"].withColumn("ambiguous_label", ~F.col("ambiguous_label"))}
    with pytest.raises(ValueError, match="digest"):
        artifacts.preflight(moved, model, state, own, VARIANTS[state["model"]])


def test_one_listing_and_a_stream_score_alike(run, spark, tmp_path):
    folder, _, _, (catalog, listings, _) = run
    row = listings.filter("product_id = 'g4'")
    single = raw.one_listing(spark, *(row.first()[c] for c in ("title", "manufacturer", "description")), "14.5")
    shown = pipeline.score_listings(single, folder).collect()
    assert shown[0].model_rank == 1 and shown[0].action in ("auto_match", "auto_no_match", "manual_review") and shown[1].action is None
    row.withColumn("price", F.lit(14.5)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(row.schema).parquet(f"{tmp_path}/in")
    score_stream(stream, folder, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").filter("model_rank = 1").first()
    assert (got.amazon_id, round(got.probability, 9), got.action) == (shown[0].amazon_id, round(shown[0].probability, 9), shown[0].action)
    with pytest.raises(ValueError):
        raw.one_listing(spark, "t", price="-1")


CSV = {
    "Amazon.csv": 'id,title,description,manufacturer,price\nb1,"A ""quoted"" title","two\nlines",NA,$5\nb1,again,x,y,1\n,blank,x,y,2\n',
    "google products.csv": "id,name,description,manufacturer,price\nu1,caf\xe9,\\back,null,GBP 5\nu2,Plain,,,7 usd\n",
    "Amzon_GoogleProducts_perfectMapping.csv": "idAmazon,idGoogleBase\nb1,u1\nb1,u1\n,u2\n",
}


@pytest.mark.parametrize("packed", [False, True])
def test_raw_files(spark, tmp_path, packed):
    if packed:
        with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
            for name, body in CSV.items():
                z.writestr(f"inner/{name}", body.encode("latin-1"))
    else:
        for name, body in CSV.items():
            (tmp_path / name).write_bytes(body.encode("latin-1"))
    catalog, listings, gold = raw.load(spark, str(tmp_path))
    a = catalog.collect()
    assert [(r.product_id, r.title, r.description, r.manufacturer, r.price) for r in a] == [("b1", 'A "quoted" title', "two lines", "", 5.0)]
    g = {r.product_id: r for r in listings.collect()}
    assert (g["u1"].title, g["u1"].description, g["u1"].price, g["u2"].price) == ("café", "\\back", None, 7.0)
    assert [tuple(r) for r in gold.collect()] == [("u1", "b1")]
    assert all(len(d) == 64 for d in raw.digests(spark, raw.find_files(str(tmp_path))).values())


def test_lost_files_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="gold"):
        raw.find_files(str(tmp_path))
    with pytest.raises(KeyError):
        raw.roles(spark.createDataFrame([(1,)], "x int"), {"title": ("title", "name")})
    with pytest.raises(ValueError):
        raw.products(spark.createDataFrame([(1,)], "x int"), "ebay")
    with pytest.raises(ValueError):
        settings.from_mapping([1])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_has_stable_columns(spark, sf_dir, name):
    made = queries.QUERIES[name](spark, sf_dir)
    assert len(set(made.columns)) == len(made.columns) > 0
    assert all(kind != "void" for _, kind in made.dtypes)


def test_oracles_belong_to_queries():
    assert not set(queries.ORACLES) - set(queries.QUERIES)


class Letters:
    """A sentence model of vowel counts."""

    def encode(self, texts, batch_size, **options):
        assert len(texts) <= batch_size and options["normalize_embeddings"]
        return np.array([[t.count(v) + 1.0 for v in "aeiou"] for t in texts])


def test_encoders_load_once_and_work_in_batches(spark):
    own = SentenceEncoder("letters", "r1", batch_size=3, load=lambda e: Letters())
    texts = spark.createDataFrame([(f"k{i}", "aei" * i) for i in range(10)] + [("none", None)], "key string, text string").repartition(2)
    got = {r.key: list(r.embedding) for r in own(texts).collect()}
    assert got["k2"] == [3, 3, 3, 1, 1] and got["none"] == [1] * 5 and len(got) == 11
    assert identity(own) == {"model": "letters", "revision": "r1"} and identity(pipeline.hashing_encoder)["model"].endswith("hashing_encoder")
    for bad in ({"model": "", "revision": "r"}, {"model": "m", "revision": " "}, {"model": "m", "revision": "r", "batch_size": 0}):
        with pytest.raises(ValueError):
            SentenceEncoder(**bad)


def test_assignments_as_csv_keep_ids_as_text(spark, tmp_path):
    rows = [("007", "component_00000", "train", "1e5", 1, True), ("1.0", "component_00001", "test", 'd,"x', 2, False)]
    made = spark.createDataFrame(rows, "google_id string, component_id string, split string, duplicate_group_id string, duplicate_group_size long, ambiguous_label boolean")
    artifacts.write_assignments(made, f"file://{tmp_path}/a")
    assert sorted(map(tuple, artifacts.read_assignments(spark, f"file://{tmp_path}/a").collect())) == rows
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.write_assignments(made, f"file://{tmp_path}/a")


def test_json_of_other_numbers():
    got = json.loads(artifacts.canonical_json({"a": np.int64(3), "b": np.float32(0.5), "c": np.array([1, 2]), "d": float("inf"), "e": {2, 1}, "f": np.nan, "g": np.bool_(True)}))
    assert got == {"a": 3, "b": 0.5, "c": [1, 2], "d": None, "e": [1, 2], "f": None, "g": True}


def test_unknown_settings_are_refused():
    with pytest.raises(ValueError, match="nonsense"):
        settings.from_mapping({"nonsense": 1})
