"""The whole chain over small hand-written input files."""

import csv
import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from placeweave import fixed
from placeweave.operators.checks import CheckFailed
from placeweave.plans import business, collection, feeds, master
from placeweave.plans.build import Inputs, build
from placeweave.sources.documents import read_key_config, read_pages
from placeweave.sources.schemas import LICENCE_COLUMNS
from placeweave.sources.tables import read_table

NAMES = ["Rogers Park", "Hyde Park", "Riverdale"]
SLUGS = ["rogers_park", "hyde_park", "riverdale"]


def write_csv(path, header, lines, opener=open):
    with opener(path, "wt", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(header)
        writer.writerows(lines)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    write_csv(root / "lookup.csv", ["community_area_number", "name", "slug", "reddit_search_term", "subreddit"],
              [[i + 1, NAMES[i], SLUGS[i], "x", "NA"] for i in range(3)])
    header = [h for h, _ in LICENCE_COLUMNS]

    def licence(area, description, status="AAC", activity=""):
        row = dict.fromkeys(header, "")
        row |= {"COMMUNITY AREA": area, "LICENSE DESCRIPTION": description, "LICENSE STATUS": status,
                "BUSINESS ACTIVITY": activity, "LATITUDE": "41.9", "LONGITUDE": "bad"}
        return [row[h] for h in header]

    write_csv(root / "licences.csv", header, [
        licence(" 01", "Retail Food"), licence("1", "Barber Shop"), licence("1", "Child Care"), licence("1", "", activity="Museum"),
        licence("1", "Hotel", status="REV"), licence("2", "Zzz"), licence("78", "Bakery"), licence("x", "Bakery"),
        licence("", "Bakery")])
    posts = root / "posts"
    posts.mkdir()
    texts = ["good coffee shop near wicker park", "good good bad day https://x.y/z", "nothing", "tiny"]
    (posts / "rogers_park.json").write_text(json.dumps({"slug": SLUGS[0], "posts": [
        {"id": str(i), "title": "", "selftext": t, "score": i, "num_comments": 1} for i, t in enumerate(texts)]}))
    (posts / "hyde_park.json").write_text("{broken")
    box = [[-1, -1], [1, -1], [1, 1], [-1, 1], [-1, -1]]
    (root / "regions.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"area_numbe": "2"}, "geometry": {"type": "Polygon", "coordinates": [box]}}]}))
    listing = ["id", "latitude", "longitude", "price", "room_type", "reviews_per_month"]
    write_csv(root / "l1.csv", listing, [[1, 0, 0, "$100.00", "Private", 1], [2, .5, .5, "$1,150.00", "Entire", ""],
                                         [4, .2, .2, "", "Entire", 3], [5, "", 0, "$9", "Entire", 3]])
    write_csv(root / "l2.csv", listing, [[1, 0, 0, "$200.00", "Private", 2], [3, 9, 9, "$5.00", "Entire", 3]])
    review = ["listing_id", "id", "date", "reviewer_id", "comments"]
    write_csv(root / "r1.csv.gz", review, [[1, 7, "2025-01-01", 70, "lovely lake view and good host"],
                                           [2, 8, "2025-01-02", 71, "lovely lake view"], [2, 9, "2025-01-03", 72, "short"],
                                           [3, 9, "2025-01-04", 73, "outside every area here"]], gzip.open)
    write_csv(root / "r2.csv.gz", review, [[1, 7, "2025-01-01", 70, "bad words in the later copy"]], gzip.open)
    (root / "texts").mkdir()
    (root / "texts" / "hyde_park.txt").write_text("# Hyde\n\nA park.\n")
    return Inputs(
        lookup=str(root / "lookup.csv"), licences=str(root / "licences.csv"), posts=str(posts),
        valued_lexicon=spark.createDataFrame([("good", 3), ("bad", -3), ("lovely", 2)], "word string, value int"),
        polar_lexicon=spark.createDataFrame([("good", "positive"), ("bad", "negative")], "word string, sentiment string"),
        stopwords=spark.createDataFrame([("and",), ("near",)], "word string"), regions=str(root / "regions.geojson"),
        listings={"2025-06-17": str(root / "l1.csv"), "2025-09-22": str(root / "l2.csv")},
        reviews={"2025-06-17": str(root / "r1.csv.gz"), "2025-09-22": str(root / "r2.csv.gz")},
        summaries=str(root / "texts"), review_partitions=2)


@pytest.fixture(scope="module")
def out(tmp_path_factory):
    return str(tmp_path_factory.mktemp("out"))


@pytest.fixture(scope="module")
def profile(spark, inputs, out):
    return {r.slug: r for r in build(spark, inputs, out).collect()}


def test_business(profile):
    one, two, three = (profile[s] for s in SLUGS)
    assert one.total_active_businesses == 4
    assert one.top_3_categories == "Food & Beverage | Automotive & Transportation | Education, Arts & Recreation"
    assert one.business_diversity_index == pytest.approx(-(0.5 * math.log(.5) + 2 * .25 * math.log(.25)))
    assert (two.total_active_businesses, two.top_3_categories, two.business_diversity_index) == (1, "Other", 0)
    assert (three.total_active_businesses, three.top_3_categories, three.business_diversity_index) == (0, "No data", 0)


def test_forum(profile):
    one, two = profile["rogers_park"], profile["hyde_park"]
    assert (one.post_count, one.total_engagement, one.data_quality_flag) == (3, 6, "low_reddit")
    assert one.mean_sentiment_score == pytest.approx((3 + 1) / 2)
    assert one.sd_sentiment_score == pytest.approx(math.sqrt(2))
    assert (one.bing_positive, one.bing_negative, one.bing_pos_ratio) == (3, 1, pytest.approx(3 / 5))
    assert one.sentiment_label == "Positive"
    assert (two.post_count, two.mean_sentiment_score, two.sentiment_label) == (0, 0, "Neutral")
    assert two.data_quality_flag == "business_only" and two.bing_positive is None and two.total_engagement is None


def test_listings(profile, spark, out):
    two = profile["hyde_park"]
    assert (two.airbnb_listing_count, two.airbnb_median_price, two.airbnb_avg_rating) == (3, 675.0, 2.5)
    assert (two.airbnb_data_flag, two.airbnb_sentiment_label) == ("full", "Positive")
    assert (profile["riverdale"].airbnb_listing_count, profile["riverdale"].airbnb_data_flag) == (0, "no_airbnb")
    assert profile["riverdale"].airbnb_median_price is None
    summary = {r.slug: r for r in read_table(spark, f"{out}/listings/summary").collect()}
    assert summary["hyde_park"].airbnb_mean_sentiment == pytest.approx((2.5 + 2) / 2)
    assert "lovely lake view" in summary["hyde_park"].airbnb_top_words.split(", ")
    rooms = {r.room_type: r.n_listings for r in read_table(spark, f"{out}/listings/by_room_type").collect()}
    assert rooms == {"Private": 1, "Entire": 2}


def test_stages_and_summaries(profile, spark, inputs, out):
    assert profile["hyde_park"].ai_summary == "# Hyde A park." and profile["riverdale"].ai_summary is None
    assert read_table(spark, f"{out}/forum/rejects").count() == 1
    prompts = {r.slug: r.prompt for r in read_table(spark, f"{out}/prompts").collect()}
    assert set(prompts) == {"rogers_park", "riverdale"}
    again = build(spark, inputs, out)
    assert again.count() == 3


def test_every_stage_accounts_for_its_rows(profile, spark, out):
    found = {(r.stage, r.step): r.rows for r in read_table(spark, f"{out}/accounting/*").collect()}
    assert found == {
        ("business", "licences raw"): 9, ("business", "licences active"): 8,
        ("forum", "files rejected"): 1, ("forum", "posts raw"): 4, ("forum", "posts kept"): 3,
        ("listings", "listings raw"): 6, ("listings", "listings unique"): 5, ("listings", "listings placed"): 3,
        ("listings", "reviews raw"): 5, ("listings", "reviews kept"): 2}


def test_prompts(spark, out):
    prompts = {r.slug: r.prompt.split("\n") for r in read_table(spark, f"{out}/prompts").collect()}
    one, three = prompts["rogers_park"], prompts["riverdale"]
    assert one[1].startswith("Write a 3–4 sentence summary of the Rogers Park neighborhood")
    assert one[3] == "Do not begin with 'Rogers Park is...'"
    assert "- Active business licenses: 4" in one and "- Overall community sentiment: Positive" in one
    assert "- Business diversity index (Shannon entropy): 1.04" in one
    assert fixed.PROMPT_NO_LISTINGS in one and fixed.PROMPT_NO_POSTS in three
    assert "- Business diversity index (Shannon entropy): 0" in three
    assert three[-1] == "Write the summary now:" and three[-2] == ""


def test_prompt_of_a_place_with_listings(spark, out):
    tables = [read_table(spark, f"{out}/{t}") for t in ("business/summary", "forum/scores", "listings/summary")]
    every = {r.slug: r.prompt for r in master.prompt_table(*tables).collect()}
    assert len(every) == 3
    assert "- Active Airbnb listings: 3\n- Median nightly price: $675\n" in every["hyde_park"]
    none = master.prompt_table(tables[0], tables[1]).filter("slug = 'hyde_park'").first().prompt
    assert fixed.PROMPT_NO_LISTINGS in none


def test_feeds(profile, spark, out):
    table = read_table(spark, f"{out}/master")
    cards = {r.slug: r for r in feeds.card_feed(table).collect()}
    assert (cards["hyde_park"].price, cards["hyde_park"].listings, cards["riverdale"].price) == ("$675", "3", "—")
    assert cards["rogers_park"].badge_class == "positive"
    assert cards["rogers_park"].notices == "⚠ limited Reddit data; no Airbnb data"
    assert cards["riverdale"].summary == "_No AI summary available._"
    bare = feeds.card_feed(table.drop("airbnb_listing_count", "airbnb_data_flag", "airbnb_median_price")).first()
    assert (bare.listings, bare.price, bare.show_visitor_phrases) == ("—", "—", False)
    assert tuple(feeds.totals(table).first()) == (3, 5, "5")
    assert {r.sentiment_label: r.n for r in feeds.label_counts(table).collect()} == {"Positive": 1, "Neutral": 2}
    assert feeds.overview_top(table, 2).count() == 2
    assert feeds.subset(table, 2, rows=3).count() == 2 and feeds.subset(table, 0, rows=3).count() == 3
    assert feeds.one_place(table, "riverdale").count() == 1
    regions = spark.createDataFrame([(1,), (9,)], "community_area_number int")
    labels = {r.community_area_number: r.label for r in feeds.map_feed(regions, table).collect()}
    assert labels == {1: "Rogers Park (2)", 9: "NA (NA)"}
    bars = feeds.category_bars(read_table(spark, f"{out}/business/by_category")).filter("slug = 'rogers_park'")
    assert [(r.bar, r.n) for r in bars.orderBy("bar").collect()] == [(1, 2), (2, 1), (3, 1)]
    phrases = feeds.phrase_bars(read_table(spark, f"{out}/forum/phrases"), table)
    assert {r.slug for r in phrases.collect()} == {"rogers_park"}


def test_failed_checks_write_nothing(spark, inputs, tmp_path):
    (tmp_path / "lookup.csv").write_text("community_area_number,name,slug\n1,A,\n")
    bad = Inputs(**{**inputs.__dict__, "lookup": str(tmp_path / "lookup.csv")})
    with pytest.raises(CheckFailed, match="no_null_slug"):
        build(spark, bad, str(tmp_path / "o"))
    assert not (tmp_path / "o" / "business").exists()


def test_collection_rules(spark):
    def post(slug, kind, name, position, id, feed="new"):
        return (slug, kind, name, {"zeta": 0, "alpha": 1}.get(name, 0), feed, 1, position, id)

    landed = spark.createDataFrame(
        [post("a", "dedicated", "A", 1, "x"), post("a", "primary", "city", 1, "x"), post("a", "primary", "city", 2, "y"),
         post("a", "fallback", "ask", 1, "z"), post("b", "primary", "city", 1, "p"), post("b", "primary", "city", 2, ""),
         post("b", "primary", "city", 3, "q"), post("b", "fallback", "ask", 1, "r"), post("d", "primary", "city", 1, "w")],
        "slug string, source_kind string, source_name string, source_no int, feed string, feed_no int, position int, id string")
    config = spark.createDataFrame(
        [(s, s.upper(), subs, "city", "ask") for s, subs in (("a", ["A"]), ("b", []), ("c", ["C"]), ("d", []))],
        "slug string, name string, subreddits array<string>, primary_subreddit string, fallback_subreddit string")
    already = spark.createDataFrame([("d", 40, "r/old")], "slug string, post_count bigint, sources string")
    done = collection.collected(landed, config, already, at_least=3)
    assert sorted((r.slug, r.id, r.source_kind) for r in done["posts"].collect()) == [
        ("a", "x", "dedicated"), ("a", "y", "primary"), ("a", "z", "fallback"), ("b", "p", "primary"), ("b", "q", "primary")]
    log = {r.slug: (r.name, r.post_count, r.sources, r.status) for r in done["log"].collect()}
    assert log == {"a": ("A", 3, "r/A,r/city,r/ask", "collected"), "b": ("B", 2, "r/city", "collected"),
                   "c": ("C", 0, "r/C", "collected"), "d": ("D", 40, "r/old", "skipped")}
    capped = collection.collect_posts(landed, at_least=3, cap=1)
    assert sorted(r.id for r in capped.filter("slug = 'b'").collect()) == ["p", "r"]
    counted = done["posts"].agg(F.count("*")).first()[0]
    assert counted == 5
    both = spark.createDataFrame([post("a", "dedicated", "alpha", 1, "x"), post("a", "dedicated", "zeta", 1, "x")], landed.schema)
    assert [r.source_name for r in collection.collect_posts(both).collect()] == ["zeta"]
    many = landed.filter("id = 'p'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(1500)))).withColumn(
        "id", F.col("n").cast("string")).withColumn("position", F.col("n")).drop("n")
    assert collection.collect_posts(many).count() == 1500
    ruled = config.withColumn("max_posts", F.lit(700)).withColumn("min_posts_threshold", F.lit(2))
    assert {r.slug: r.post_count for r in collection.collected(many, ruled)["log"].collect()}["b"] == 700


# ---------------------------------------------------------------- collection as a stage

def listing(*posts):
    return json.dumps({"data": {"children": [{"data": p} for p in posts]}})


def page(slug, kind, name, number, payload, feed="new"):
    return {"slug": slug, "source_kind": kind, "source_name": name, "source_no": 0, "feed": feed, "feed_no": 0, "page": number,
            "payload": payload}


def said(id, text="some words of a post", score=1):
    return {"id": id, "title": text, "selftext": "", "score": score, "num_comments": 1, "subreddit": "s"}


@pytest.fixture
def landed(tmp_path):
    """Landed pages and a config of two keys, as files; more pages can be added."""
    def add(name, pages):
        (tmp_path / "pages").mkdir(exist_ok=True)
        (tmp_path / "pages" / f"{name}.json").write_text("\n".join(map(json.dumps, pages)))
    add("one", [page("rogers_park", "primary", "city", 2, listing(said("c"), said("a", score=9))),
                page("rogers_park", "primary", "city", 1, listing(said("a"), said("b"), said(""))),
                page("rogers_park", "dedicated", "RP", 1, listing(said("b", score=5))),
                page("rogers_park", "fallback", "ask", 1, listing(said("z"))), page("rogers_park", "primary", "city", 3, '{"data": {"chi'),
                page("rogers_park", "primary", "city", 4, "{}"), page("hyde_park", "fallback", "ask", 1, listing(said("z"))),
                page("nowhere", "primary", "city", 1, listing(said("n")))])
    (tmp_path / "config.json").write_text(json.dumps({
        "min_posts_threshold": 4, "max_posts": 4, "primary_subreddit": "city", "fallback_subreddit": "ask", "neighborhoods": [
            {"slug": s, "name": n, "search_term": "t", "subreddits": d} for s, n, d in
            zip(SLUGS, NAMES, (["RP"], [], ["none"]))]}))
    return add, str(tmp_path / "pages"), str(tmp_path / "config.json")


def test_collection_stage(spark, landed, tmp_path):
    add, where, config = landed
    pages, config = read_pages(spark, where), read_key_config(spark, config)
    stage = collection.Collection(spark, str(tmp_path / "c"), buckets=4)
    first = {r.slug: tuple(r)[2:] for r in stage.collect(pages, config.filter("slug <> 'riverdale'")).collect()}
    # five posts landed from the primary source count as its cap of four, so the fallback is left out
    assert first == {"rogers_park": (3, "r/RP,r/city", "collected"), "hyde_park": (1, "r/ask", "collected")}
    stored = {r.slug: r for r in stage.documents().read().collect()}
    assert [(p.id, p.score) for p in stored["rogers_park"].posts] == [("b", 5), ("a", 1), ("c", 1)]
    assert sorted(r.post_id for r in stage.posts().collect()) == ["a", "b", "c", "z"]
    add("two", [page("hyde_park", "primary", "city", 1, listing(*[said(str(i)) for i in range(9)])),
                page("rogers_park", "dedicated", "RP", 2, listing(said("new")))])
    pages = read_pages(spark, where)
    again = {r.slug: tuple(r)[2:] for r in stage.collect(pages, config, recollect_at_least=3).collect()}
    # the large key is collected anew, the small one is left alone though more was landed, an empty one has its document
    assert again == {"rogers_park": (4, "r/RP,r/city", "collected"), "hyde_park": (1, "r/ask", "skipped"),
                     "riverdale": (0, "r/none", "collected")}
    assert stage.documents().read(["riverdale"]).first().posts == []
    assert {r.status for r in stage.collect(pages, config).collect()} == {"skipped"}
    none = collection.Collection(spark, str(tmp_path / "n"), buckets=2)
    assert none.collect(pages.limit(0), config.limit(0)).count() == 0 and none.posts().count() == 0


def test_collection_that_broke_off(spark, landed, tmp_path, monkeypatch):
    """Documents without their log: the next run logs the keys as it finds them."""
    _, pages, config = landed
    pages, config = read_pages(spark, pages), read_key_config(spark, config)
    stage = collection.Collection(spark, str(tmp_path / "c"), buckets=2)

    def lost(self):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(collection.Collection, "log", lost)
        stage.collect(pages, config)
    assert stage.log().read().count() == 0
    log = {r.slug: (r.post_count, r.status) for r in stage.collect(pages, config).collect()}
    assert log == {"rogers_park": (3, "skipped"), "hyde_park": (1, "skipped"), "riverdale": (0, "skipped")}


def test_build_from_landed_pages(spark, inputs, landed, tmp_path):
    _, pages, config = landed
    chain = Inputs(**{**inputs.__dict__, "posts": None, "pages": pages, "key_config": config, "listings": {}, "reviews": {}})
    out = str(tmp_path / "out")
    rows = {r.slug: r.post_count for r in build(spark, chain, out).collect()}
    assert rows == {"rogers_park": 3, "hyde_park": 1, "riverdale": 0}
    rejects = read_table(spark, f"{out}/forum/rejects").collect()
    assert [(r.file, r.record) for r in rejects] == [("rogers_park/city/new/3", '{"data": {"chi')]
    steps = {r.step: r.rows for r in read_table(spark, f"{out}/accounting/forum").collect()}
    assert steps == {"pages to read": 7, "posts landed": 8, "files rejected": 1, "posts raw": 4, "posts kept": 4}


def test_licences_are_counted_before_their_texts_are_read(spark):
    """Patterns and numbers meet each pair of area and description once, not each licence."""
    rows = [(" 07", "Barber Shop", None), ("7", "Barber Shop", "x"), ("7", None, "Barber Shop"), ("7", None, None), ("8", "Dental", None),
            ("8", "Clinic", None), ("99", "Dental", None), ("x", "Dental", None), ("", "Dental", None), (None, "Dental", None)]
    licences = spark.createDataFrame(rows, "community_area string, license_description string, business_activity string")
    lookup = spark.createDataFrame([(7, "A", "a"), (8, "B", "b"), (9, "C", "c")], "community_area_number int, name string, slug string")
    got = business.business_profile(licences, lookup)
    assert {(r.slug, r.category, r.n) for r in got["by_category"].collect()} == {
        ("a", "Food & Beverage", 3), ("a", "Other", 1), ("b", "Health & Personal Care", 2)}
    assert {r.slug: r.total_active_businesses for r in got["summary"].collect()} == {"a": 4, "b": 2, "c": 0}
    plan = got["by_category"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") > 0 and plan.rindex("RLIKE(") < plan.rindex("Aggregate [community_area#")  # the tree's top comes first
