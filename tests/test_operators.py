"""Golden and brute-force cases of the operators."""

import gc
import json
import random
import weakref
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from larder import session
from larder.functions import metadata
from larder.functions import plan_text as P
from larder.operators import catalogue, documents, facets, hooks, network, ordering, plan, postings, profiles, search, toc
from larder.operators import pdf_templates as pdf
from larder.sources import html, plan_files


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- ordering and search ---------------------------------------------------------------------


def test_ranked_with_a_hot_group(spark):
    """One group holds most rows and many partitions; numbers match a plain sort."""
    df = spark.range(20000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).alias("k"), ((F.col("id") * 7919) % 20011).alias("v"))
    got = ordering.ranked(df.repartition(7), [F.asc("v")], ["k"]).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r["k"], []).append((r["rank"], r["v"]))
    for pairs in by_key.values():
        pairs.sort()
        assert [p[0] for p in pairs] == list(range(1, len(pairs) + 1))
        assert [p[1] for p in pairs] == sorted(p[1] for p in pairs)


def test_long_top_lists_are_ranked_over_partitions(spark, monkeypatch):
    df = spark.range(500).select(((F.col("id") * 37) % 501).alias("v"))
    want = rows(ordering.top_ranked(df, [F.asc("v")], 20).orderBy("rank"), "rank", "v")
    monkeypatch.setattr(ordering, "SHORT_LIST", 5)
    assert rows(ordering.top_ranked(df, [F.asc("v")], 20).orderBy("rank"), "rank", "v") == want


def test_hybrid_limits_agree_with_the_full_ranking(spark):
    """The bounded path gives the head of the unbounded one."""
    words = ["salt", "garlic", "onion", "basil", "lime"]
    data = [(i, f"{words[i % 5]} {words[(i * 3) % 5]}", "book", [words[(i // 2) % 5]], ["raw"], ["cook"], "x", i) for i in range(200)]
    dishes = spark.createDataFrame(
        data, "recipe_id long, title string, cookbook_title string, ingredient_names array<string>, ingredient_raw array<string>, "
              "method_steps array<string>, excerpt string, scan_order long")
    vectors = spark.createDataFrame([(i, [float(i % 17), float(i % 5), 1.0]) for i in range(200)], "recipe_id long, embedding array<float>")
    full = rows(search.hybrid_search(dishes, None, vectors, "salt lime", [1.0, 2.0, 0.5]).limit(200), "recipe_id", "score")
    scored = {r["recipe_id"]: r["score"] for r in search.keyword_score(dishes, ["salt", "lime"]).collect()}
    keyword = {k: i + 1 for i, k in enumerate(sorted(scored, key=lambda k: (-scored[k], k)))}
    q = [1.0, 2.0, 0.5]

    def cos(i):
        v = [float(i % 17), float(i % 5), 1.0]
        return sum(a * b for a, b in zip(v, q)) / ((sum(a * a for a in v) * sum(b * b for b in q)) ** 0.5)

    for limit in (3, 10):
        near = sorted(range(200), key=lambda i: (-cos(i), i))[: search.fan_out(limit)]
        semantic = {k: i + 1 for i, k in enumerate(near)}
        fused = {k: (1 / (60 + keyword[k]) if k in keyword else 0) + (1 / (60 + semantic[k]) if k in semantic else 0) for k in {*keyword, *semantic}}
        want = sorted(fused, key=lambda k: (-fused[k], k))[:limit]
        got = search.hybrid_search(dishes, None, vectors, "salt lime", q, limit=limit)
        assert sorted(r["recipe_id"] for r in got.collect()) == sorted(want)
    assert len(full) == 200


def test_keyword_suggestions_and_empty_queries(spark):
    data = [(1, "Mango salad", "B", [], [], [], "", 1), (2, "Lime pie", "B", [], ["mango"], [], "", 2), (3, "Bread", "B", [], [], [], "", 3)]
    dishes = spark.createDataFrame(
        data, "recipe_id long, title string, cookbook_title string, ingredient_names array<string>, ingredient_raw array<string>, "
              "method_steps array<string>, excerpt string, scan_order long")
    assert [r[0] for r in rows(search.keyword_topk(dishes, "mango", 2), "recipe_id")] == [1, 2]
    assert rows(search.hybrid_search(dishes, None, None, "zzz"), "recipe_id") == []
    assert rows(search.hybrid_search(dishes, None, None), "recipe_id", "score") == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_facets(spark):
    index = spark.createDataFrame([(1, "salt"), (1, "lime"), (2, "salt"), (3, "salt"), (3, "lime"), (3, "limes")], "recipe_id long, name string")
    assert rows(facets.facet_and(index, ["Salt, the lime"]), "recipe_id") == [(1,), (3,)]
    assert rows(facets.facet_drilldown(index, ["salt"]), "name", "recipe_count") == [("lime", 2), ("limes", 1)]
    assert rows(facets.facet_prefix(index, "lim"), "name") == [("lime",), ("limes",)]
    assert rows(facets.facet_substring(index, ["salt"], "imes"), "name") == [("limes",)]


# --- network ---------------------------------------------------------------------------------


def test_live_preview(spark):
    baskets = [["salt", "garlic", "onion"], ["salt", "garlic"], ["salt", "onion"], ["salt", "basil"], ["garlic", "onion"]]
    index = spark.createDataFrame([(i, n) for i, b in enumerate(baskets) for n in b], "recipe_id long, name string")
    nodes, links, counts = network.graph_preview_live(index, 2, 3, 10)
    assert [r[0] for r in sorted(rows(nodes, "name", "rank"), key=lambda r: r[1])] == ["salt", "garlic", "onion"]
    assert sorted(rows(links, "src", "dst", "weight")) == [("garlic", "onion", 2), ("garlic", "salt", 2), ("onion", "salt", 2)]
    assert rows(counts, "edge_count") == [(3,)]


def test_large_groups_pair_like_small_ones(spark):
    """A group above the array limit goes through the grid and counts the same pairs."""
    size = network.SMALL_GROUP + 45
    index = spark.createDataFrame([(0, i) for i in range(size)] + [(1, 3), (1, 7), (2, 7)], "recipe_id long, name long")
    edges = network.cooccurrence(index).cache()
    assert edges.count() == size * (size - 1) // 2
    assert rows(edges.where("weight > 1"), "src", "dst", "weight") == [(3, 7, 2)]
    assert edges.where("src >= dst").isEmpty()


def test_components_and_paths(spark):
    nodes = spark.createDataFrame([(n, 3) for n in "abcdefg"], "name string, frequency long")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "c", 4), ("c", "d", 1), ("e", "f", 1)], "src string, dst string, weight long")
    sizes = sorted(rows(network.connected_components(nodes, edges), "component", "size"))
    assert sizes == [("a", 4), ("e", 2), ("g", 1)]
    inner = network.within(edges, network.giant_component(nodes, edges))
    metrics = network.path_metrics(inner)
    assert rows(network.path_scalars(metrics), "diameter") == [(2,)]
    some = nodes.where("name = 'd'").select("name")
    assert rows(network.path_metrics(inner, some), "name", "total_distance") == [("d", 5)]
    weighted = dict(rows(network.weighted_closeness(inner), "name", "weighted_closeness"))
    assert weighted["a"] == pytest.approx(3 / (0.5 + 0.75 + 1.5))


def test_long_chain_is_one_component(spark):
    n = 300
    nodes = spark.range(n).select(F.col("id").alias("name"), F.lit(3).alias("frequency"))
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).alias("weight"))
    assert rows(network.connected_components(nodes, edges), "component", "size") == [(0, n)]


# --- plan ------------------------------------------------------------------------------------


def test_plan_text(spark):
    text = "\n".join([
        "Dinners:", "Week of 14 April 2024", "- [x] Monday - Fish pie", "- Pasta", "  • use frozen peas", "", "• Soup", "Lunches", "- Salad https://example.com/s",
        "Day\tLunch\tDinner", "Tuesday\tToast\tCurry", "https://example.com/link/", "loose words", "11 apr", "Tally out",
    ])
    lines = plan_files.plan_lines(spark.createDataFrame([("f", text)], "file_id string, text string"))
    entries = plan.plan_carry_forward(lines)
    got = rows(entries.orderBy("section_no", "group_at", "line_no", "slot"), "section_title", "group_title", "title", "is_recipe", "is_complete")
    assert got == [
        ("Week of 14 April 2024", "Dinners", "Monday - Fish pie", True, True),
        ("Week of 14 April 2024", "Dinners", "Pasta", True, None),
        ("Week of 14 April 2024", "Dinners", "Soup", False, None),
        ("Week of 14 April 2024", "Dinners", "Curry", True, None),
        ("Week of 14 April 2024", "Lunches", "Salad", True, None),
        ("Week of 14 April 2024", "Lunches", "Day Lunch Dinner", False, None),
        ("Week of 14 April 2024", "Lunches", "Toast", True, None),
        ("Week of 14 April 2024", "Lunches", "example.com/link", False, None),
        ("Week of 14 April 2024", "Lunches", "loose words", False, None),
        ("11 apr", "Meals", "Tally out", False, None),
    ]
    weeks = plan.plan_rows_from_entries(entries, 2024)
    first = [r for r in weeks.collect() if r["title"] == "Fish pie"][0]
    assert (first["weekday"], first["meal"], first["start_on"], first["completed"]) == ("Monday", "Dinner", "2024-04-14", True)
    notes = dict(rows(plan.plan_notes(weeks), "section_no", "notes"))
    assert notes[1].split("\n")[0] == "Any day Dinner notes: use frozen peas"
    assert rows(plan.recent_weeks(entries, 1).select("section_title").distinct(), "section_title") == [("Week of 14 April 2024",)]


def _brute_force(titles, dishes):
    """The matching rule compared pair by pair."""
    import re

    stop = set(P.STOPWORDS)

    def meal(text):
        tokens = re.sub(r"[^a-z0-9]+", " ", text.lower().replace("&", " and ")).split()
        out = []
        for t in tokens:
            if t in stop:
                continue
            t = P.TOKEN_ALIASES.get(t, t)
            if len(t) > 4 and t.endswith("ies"):
                t = t[:-3] + "y"
            elif len(t) > 4 and t.endswith("s") and not t.endswith(("ss", "us")):
                t = t[:-1]
            out.append(t)
        return " ".join(out)

    found = {}
    for title in titles:
        v = meal(title)
        scored = []
        for rid, name in dishes:
            norm = meal(name)
            vt, rt = set(v.split()), set(norm.split())
            shared = len(vt & rt)
            ratio = SequenceMatcher(None, v, norm).ratio()
            s = ratio * 0.46 + shared / max(len(vt), len(rt)) * 0.22 + shared / len(vt) * 0.32
            s += 0.08 * (v in norm or norm in v) + 0.08 * (vt <= rt) - 0.12 * (len(vt) == 1 and ratio < 0.7)
            s = 1.0 if v == norm else s
            if s >= 0.74:
                scored.append((s, rid))
        scored.sort(key=lambda x: -x[0])
        if scored and scored[0][0] >= 0.81 and (len(scored) == 1 or scored[0][0] - scored[1][0] >= 0.035):
            found[title] = (scored[0][1], round(scored[0][0], 4))
    return found


def test_fuzzy_match_equals_brute_force(spark):
    names = ["Fish pie", "Chicken and leek pie", "Roast chicken salad", "Lentil daal with spinach", "Spinach lentil soup", "Tomato pasta", "Beef stew", "Leek tart", "Beef stews"]
    titles = ["Fish pies", "chicken leek pie", "Roasted chicken salads", "lentil dahl spinach", "tomato pastas bake", "pie", "leek", "Beef stewed", "chicken", "spinach soup lentil"]
    dishes = list(enumerate(names))
    got = plan.fuzzy_title_match(
        spark.createDataFrame([(t,) for t in titles], "title string"),
        spark.createDataFrame([(i, n, i) for i, n in dishes], "recipe_id int, title string, listing_order int"),
    )
    assert {r["title"]: (r["recipe_id"], r["score"]) for r in got.collect()} == _brute_force(titles, dishes)


def test_candidates_are_the_pairs_that_share_enough(spark, monkeypatch):
    monkeypatch.setattr(plan, "RARE_USES", 2, raising=False)
    names = [f"{a} {b} {c}" for a in ("red", "green", "blue") for b in ("soup", "pie", "red") for c in ("bean", "leek", "pie")]
    asked = ["red soup bean stew", "pie", "leek pie blue", "rare red", "green bean", "bean leek soup", "nothing here"]
    titles = spark.createDataFrame([(n,) for n in dict.fromkeys(names + ["rare dish"])], "norm string")
    variants = spark.createDataFrame([(v, v) for v in asked], "title string, variant string")
    for least in (0.0, 0.5, 0.75):
        pairs = plan._token_candidates(variants, titles, least, lambda v: F.split(v, " "))
        got = [(r["variant"], r["norm"], round(r["coverage"], 6)) for r in pairs.collect()]
        want = []
        for v in asked:
            for r in titles.collect():
                shared = len(set(v.split()) & set(r["norm"].split()))
                if shared >= max(1, least * len(set(v.split()))):
                    want.append((v, r["norm"], round(shared / len(set(v.split())), 6)))
        assert sorted(got) == sorted(want)


def test_candidates_by_characters_and_runs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(plan, "RARE_USES", 3)
    draw = random.Random(5)
    words = ["e", "ab", "bean", "soup", "pie", "leek", "roast", "lentils", "chicken", "red", "q"]
    names = [" ".join(draw.choices(words, k=draw.randint(1, 11))) for _ in range(120)]
    cuts = [n[draw.randint(0, 3) : len(n) - draw.randint(0, 3)].strip() for n in names[:60]]
    titles = [t for t in cuts + [f"x{n}y z" for n in names[60:90]] + [" ".join(draw.choices(words, k=9)) for _ in range(40)] if t]
    dishes = list(enumerate(names))
    entries = spark.createDataFrame([(t,) for t in titles], "title string")
    known = spark.createDataFrame([(i, n, i) for i, n in dishes], "recipe_id int, title string, listing_order int")
    got = {r["title"]: (r["recipe_id"], r["score"]) for r in plan.fuzzy_title_match(entries, known).collect()}
    # Scores are rounded to four digits in another way there.
    wanted = _brute_force(titles, dishes)
    assert {t: r for t, (r, _) in got.items()} == {t: r for t, (r, _) in wanted.items()} and len(got) > 10
    assert all(got[t][1] == pytest.approx(wanted[t][1], abs=1.01e-4) for t in wanted)
    client = {r["title"]: (r["recipe_id"], round(r["score"], 6)) for r in plan.client_title_match(entries, known).collect()}
    assert client == _brute_force_client(titles, dishes) and len(client) > 10


def _brute_force_client(titles, dishes):
    """The token-only rule compared pair by pair, on titles without weekdays or brackets."""
    def meal(text):
        return " ".join(t[:-1] if len(t) > 4 and t.endswith("s") and not t.endswith(("ss", "us")) else t for t in text.split() if t not in P.STOPWORDS)

    found = {}
    for title in titles:
        v = meal(title)
        scored = []
        for norm, (copies, rid) in {m: (sum(meal(n) == m for _, n in dishes), min(i for i, n in dishes if meal(n) == m)) for m in {meal(n) for _, n in dishes}}.items():
            vt, rt = set(v.split()), set(norm.split())
            shared = len(vt & rt)
            s = shared / max(len(vt), len(rt)) * 0.5 + shared / len(vt) * 0.35 + 0.15 * (v in norm or norm in v)
            s = 1.0 if v == norm else s + 0.08 * (vt <= rt) - 0.12 * (len(vt) == 1 and shared < 1)
            if shared and s >= 0.8:
                scored.append((s, copies, rid))
        scored.sort(key=lambda x: -x[0])
        if scored and scored[0][0] >= 0.81 and sum(c for s, c, _ in scored if scored[0][0] - s < 0.035) == 1:
            found[title] = (scored[0][2], round(scored[0][0], 6))
    return found


def test_titles_apart_need_more_shared_tokens(spark):
    names = ["one two three four nine ten", "zone two three fourty", "one two three four five six seven eight more"]
    titles = spark.createDataFrame([(n,) for n in names], "norm string")
    variants = spark.createDataFrame([("one two three four five six seven eight",) * 2], "title string, variant string")
    met = plan._token_candidates(variants, titles, 0.4, P.meal_tokens, 0.75)
    assert rows(met, "norm", "inside") == [(names[2], True)]
    short = spark.createDataFrame([("ne two three four f",), ("ne two nine four f",)], "norm string")
    inside = plan._inside_candidates(variants, short, 0.3, 0.75, P.meal_tokens)
    assert rows(inside, "norm", "n_tokens") == []
    inside = plan._inside_candidates(variants, spark.createDataFrame([("ne two three four five s",)], "norm string"), 0.4, 0.75, P.meal_tokens)
    assert rows(inside, "norm", "inside", "coverage") == [("ne two three four five s", True, 0.5)]
    bits = spark.createDataFrame([("aaaaaaaab c9", "caaaaaaab 9")], "l string, r string").select(
        plan.most_matched(plan.character_bits(F.col("l")), plan.character_bits(F.col("r"))).alias("n")
    )
    assert rows(bits, "n") == [(11,)]


def test_readings_of_titles_are_worked_out_in_many_tasks(spark):
    entries = spark.range(64).select(F.concat(F.lit("Dish "), "id").alias("title"))
    dishes = entries.select(F.lit(1).alias("recipe_id"), "title", F.lit(1).alias("listing_order"))
    found = plan._variants(entries, plan.client_variants(F.col("title")))
    assert found.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert found.count() == 64 and plan._known_titles(dishes).count() == 64


def test_copies_of_the_best_title_tie(spark):
    dishes = spark.createDataFrame([(1, "Fish pie", 1), (2, "fish pies", 2)], "recipe_id int, title string, listing_order int")
    entries = spark.createDataFrame([("fish pie deluxe",), ("Fish pie",)], "title string")
    assert rows(plan.fuzzy_title_match(entries.where("title <> 'Fish pie'"), dishes), "title") == []
    assert rows(plan.exact_title_match(entries, dishes), "title", "recipe_id") == [("Fish pie", 1)]


def test_resolve_reference(spark):
    dishes = spark.createDataFrame([("recipe-1", "Title", 1), ("recipe-2", "Other dish", 2)], "recipe_id string, title string, listing_order int")
    asked = spark.createDataFrame(
        [(1, "Title - Cookbook [recipe-1]", "", ""), (2, "nothing", "Other", "recipe-1"), (3, "other dish", "", "gone"), (4, "", "", "")],
        "row_id int, value string, fallback_title string, explicit_id string")
    assert dict(rows(plan.resolve_reference(asked, dishes), "row_id", "recipe_id")) == {1: "recipe-1", 2: "recipe-1", 3: "recipe-2", 4: None}


def test_sort_plan_rows(spark):
    data = [("w1", "2026-04-19", 1, "Tuesday", "Lunch"), ("w1", "2026-04-19", 2, "Monday", "Dinner"), ("w2", "2026-04-14", 1, "Monday", ""),
            ("w2", "2026-04-14", 2, "tuesday", "Dinner"), ("w2", "2026-04-14", 3, "", ""), ("w2", "2026-04-14", 4, "Tuesday", "breakfast")]
    df = spark.createDataFrame(data, "week_id string, start_on string, row_seq int, weekday string, meal string")
    got = sorted(rows(plan.sort_plan_rows(df), "week_id", "rank", "row_seq"))
    assert got == [("w1", 1, 2), ("w1", 2, 1), ("w2", 1, 4), ("w2", 2, 2), ("w2", 3, 1), ("w2", 4, 3)]


def test_shopping_list(spark):
    plan_rows = spark.createDataFrame([("w", 1), ("w", 1), ("w", 2), ("w", 3), ("w", None)], "week_id string, recipe_id long")
    dishes = spark.createDataFrame([(1, "Salsa", []), (2, "Broth", []), (3, "Plain", [" Rice "])], "recipe_id long, title string, ingredient_names array<string>")
    lines = spark.createDataFrame(
        [(1, None, "mango", "1 mango"), (1, None, "lime", "1 lime"), (1, None, "lime", "zest of lime"), (2, "stock", "x", "1.5 litres chicken or ham stock")],
        "recipe_id long, canonical_name string, normalized_name string, raw string")
    got = sorted(rows(plan.shopping_list(plan_rows, dishes, lines), "rank", "name", "total_uses", "first_source"))
    assert got == [(1, "1.5 litres chicken or ham stock", 1, "Broth"), (2, "lime", 4, "Salsa x4"), (3, "mango", 2, "Salsa x2"), (4, "Rice", 1, "Plain")]


def test_next_week(spark):
    weeks = spark.createDataFrame([("p", 0, ""), ("p", 1, "2026-04-14"), ("p", 2, "2026-04-05")], "plan_id string, week_seq int, start_on string")
    assert rows(plan.next_week_start(weeks), "start_on") == [("2026-04-19",)]


# --- catalogue -------------------------------------------------------------------------------


def test_sort_by_author_and_management(spark):
    books = spark.createDataFrame([(1, "Z Book", "Zadie Smith", None, None), (2, "A Book", "Alice Waters", None, "nytimes"), (3, "C", None, None, "unknown")],
                                  "cookbook_id int, title string, author string, cuisine string, collection_slug string")
    got = [r[1] for r in sorted(rows(catalogue.sort_cookbooks(books, "author"), "rank", "title"))]
    assert got == ["A Book", "Z Book", "C"]
    assert sorted(rows(catalogue.management_groups(books), "group_title", "title")) == [("Books", "Z Book"), ("NYTimes", "A Book")]
    dishes = spark.createDataFrame(
        [(1, 10, ["Vegetarian", "Weeknight", "Weeknight"], ["missing_steps", "missing_steps", "unclear_title"], ["a"]), (1, 11, ["Vegetarian"], ["missing_steps"], [])],
        "cookbook_id int, recipe_id int, tags array<string>, needs_review_reasons array<string>, images array<string>")
    assert dict(rows(catalogue.photo_percent(books, dishes), "cookbook_id", "photo_recipe_percent")) == {1: 50, 2: 0, 3: 0}
    counts = sorted(rows(catalogue.cookbook_management(books, dishes), "kind", "rank", "value", "dishes"))
    assert counts == [("reason", 1, "missing_steps", 2), ("reason", 2, "unclear_title", 1), ("tag", 1, "Vegetarian", 2), ("tag", 2, "Weeknight", 1)]


# --- documents -------------------------------------------------------------------------------

PAGE = (
    "<h1>Beans on Toast</h1><p>A quick supper.</p><p>Serves 2</p><p>Prep time: 5 minutes</p><h9></h9><p>Ingredients</p><li>200g beans<li>2 slices bread"
    "<p>Method</p><p>Step 1</p><p>Warm the beans.</p><p>Stir.</p><p>2. Toast the bread.</p><img src='a.png'>"
)


def test_sections_and_fields(spark):
    pages = spark.createDataFrame([("d", PAGE)], "page_id string, html string")
    done = documents.section_fields(documents.html_sections(pages)).collect()
    assert len(done) == 1
    s = done[0]
    assert s["chapter_title"] == "Beans on Toast" and s["images"] == ["a.png"] and s["anchor"] == "d#1"
    assert s["metadata"] == {"serves": "2", "prep_time": "5 minutes", "intro": "A quick supper."}
    assert s["ingredient_lines"] == ["200g beans", "2 slices bread"]
    assert s["method_lines"] == ["Warm the beans. Stir.", "Toast the bread."]
    draft = documents.deterministic_drafts(documents.section_fields(documents.html_sections(pages))).first()
    assert draft["review_status"] == "pending_review" and [i["canonical_name"] for i in draft["ingredients"]] == ["beans", "slices bread"]


def _parts_line_by_line(lines):
    """Parts of a section's lines by a walk that carries the part from line to line."""
    mode, parts = "", {"intro": [], "ingredients": [], "method": []}
    for line in lines:
        heading = line.rstrip(":").strip().lower()
        if heading in documents.INGREDIENT_HEADINGS + documents.METHOD_HEADINGS:
            mode = "ingredients" if heading in documents.INGREDIENT_HEADINGS else "method"
        elif not line.lower().startswith(("serves", "makes", "prep time")):
            if not mode and line[0].isdigit():
                mode = "ingredients"
            parts[mode or "intro"].append(line)
    return {k: [x for i, x in enumerate(v) if i == 0 or x.lower() != v[i - 1].lower()] for k, v in parts.items()}


def test_fields_equal_a_walk_over_the_lines(spark):
    choices = ["200g flour", "2 EGGS", "2 eggs", "Stir it", "stir IT", "Serves 4", "Makes: 2", "Ingredients:", "METHOD", "Steps ::", "For the pan", "Prep time: 5"]
    draw = random.Random(3)
    data = [(i, "T", [draw.choice(choices) for _ in range(draw.randrange(9))]) for i in range(300)]
    df = spark.createDataFrame([(i, t, "\n".join(x)) for i, t, x in data], "n int, chapter_title string, text string")
    got = {r["n"]: r for r in documents.section_fields(df).collect()}
    for i, _, lines in data:
        wanted = _parts_line_by_line([x for j, x in enumerate(lines) if j == 0 or x.lower() != lines[j - 1].lower()])
        assert got[i]["ingredient_lines"] == wanted["ingredients"], lines
        assert " ".join(got[i]["method_lines"]) == " ".join(wanted["method"]), lines
        assert got[i]["metadata"].get("intro", "") == "\n\n".join(wanted["intro"]), lines


def test_parts_are_not_grown_line_by_line(spark):
    df = spark.createDataFrame([("T", "a#1", "200g x\nMethod\nStir")], "chapter_title string, anchor string, text string")
    plan = documents.section_fields(df)._jdf.queryExecution().optimizedPlan().toString()
    # Growing an array a line copies it a line; lines are squashed once, not again for each question asked of them.
    assert "array_append" not in plan and "array_insert" not in plan and plan.count("regexp_replace") <= 3


def test_units_are_found_by_both_patterns(spark):
    lines = ["200g", "2 Cups x", "a_cup", "é g", "ég", "x\u00a0ML.", "[kg]", "`l`", "{oz", "5lbs", "cupsy", "CUP", "", "aLb", "٣g", "1_g", "\U0001f35e tsp", "Z tablespoons, x"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = rows(df, "x", F.rlike("x", F.lit(metadata.MEASUREMENT)).alias("a"), F.rlike("x", F.lit(metadata.JAVA_MEASUREMENT)).alias("b"))
    assert all(a == b for _, a, b in got) and {a for _, a, _ in got} == {True, False}


def test_categories_are_looked_for_among_categories(spark):
    body = "".join(f'<p class="ct">Part {i}</p>' * (i % 3 == 0) + f'<p class="rt">Dish {i}</p><p class="ri">1 egg</p><p class="rd">Stir.</p>' for i in range(9))
    pages = spark.createDataFrame([(1, body)], "page_id int, html string")
    found = profiles.profile_sections(pages)
    assert [t.split("\n")[0] for (t,) in sorted(rows(found, "section_no", "text"))[0:0]] == []
    assert [r["text"].split("\n")[:2] for r in found.orderBy("section_no").collect()] == [[f"Part {i // 3 * 3}", f"Dish {i}"] for i in range(9)]
    # Classes of a node are compared once for titles, not once for each use of the titles' places.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("arrays_overlap") <= 55


def test_candidates(spark):
    data = [
        ("FOREWORD", "a#1", "200g x\n100g y\n3 eggs"), ("T", "pages/ottolenghi.xhtml#3", "200g x\n100g y\n3 eggs"),
        (None, "a#2", "Serves 2\n200g x\nServes 4\n100g y"), ("Dough", "a#3", "350ml water\n125ml milk\nMix."), ("Essay", "a#4", "Long words only."),
    ]
    df = spark.createDataFrame(data, "chapter_title string, anchor string, text string").withColumn("section_key", F.col("anchor"))
    assert rows(documents.candidate_sections(df), "anchor") == [("a#3",)]


def test_caption_pages(spark):
    data = [("b", 1, "Soup", True, "Soup Boil.", ["a"]), ("b", 2, None, False, "SOUP", ["b"]), ("b", 3, None, False, "soup!", ["c"]), ("b", 4, None, False, "other", ["d"])]
    df = spark.createDataFrame(data, "book string, n int, chapter_title string, has_heading boolean, excerpt string, images array<string>")
    got = sorted(rows(documents.caption_attach(df, ["book"], [F.asc("n")], ["n"]), "n", "images"))
    assert got == [(1, ["a", "b", "c"]), (4, ["d"])]


def test_profile_sections(spark):
    page = (
        '<img src="lead.png"><p class="ct">Mains</p><p>Buffered</p><p class="rt" id="r1">One</p><p class="rhn">Note</p><p class="ri">2 eggs</p>'
        '<p class="ri">2 eggs</p><p class="rd">Beat.</p><img src="one.png"><p class="rt"><a id="r2"></a>Two</p><p class="ri">1 leek</p><p class="rd-top">Cut.</p>'
    )
    other = '<p class="rec_head">Pie</p><p class="ing_head">For the crust</p><li class="ingredient_list">1 cup flour</li><p class="method">Bake.</p><img src="late.png">'
    pages = spark.createDataFrame([("a", page), ("b", other), ("c", "<p>none</p>")], "page_id string, html string")
    got = {r["anchor"]: r for r in profiles.profile_sections(pages).collect()}
    assert sorted(got) == ["a#r1", "a#r2", "b#1"]
    one, two, pie = got["a#r1"], got["a#r2"], got["b#1"]
    assert one["text"].split("\n") == ["Mains", "One", "Buffered", "Note", "2 eggs", "Beat."]
    assert one["images"] == ["lead.png", "one.png"] and one["ingredient_lines"] == ["2 eggs"] and two["method_lines"] == ["Cut."]
    assert pie["images"] == ["late.png"] and [(s["heading"], s["lines"]) for s in pie["supplemental_sections"]] == [("For the crust", ["1 cup flour"])]


def test_anchor_text(spark):
    page = '<h1 id="a">A</h1><p>one</p><h2>no id</h2><p>two</p><h2 id="b">B</h2><p>three</p>'
    pages = spark.createDataFrame([("d", page)], "doc string, html string")
    asked = spark.createDataFrame([(1, "d", "a"), (2, "d", "b"), (3, "d", "zz")], "recipe_id int, doc string, fragment string")
    got = dict(rows(documents.anchor_text(pages, asked), "recipe_id", "text"))
    assert got == {1: "A\none\nno id\ntwo", 2: "B\nthree", 3: "A\none\nno id\ntwo\nB\nthree"}


# --- tables of contents ----------------------------------------------------------------------


def _book(spark, entries, spine, dishes):
    schema = "cookbook_id string, toc array<struct<label:string,href:string,depth:int,has_children:boolean>>, spine array<string>, recipe_paths array<string>"
    return spark.createDataFrame([("b", entries, spine, dishes)], schema)


def test_chapter_maps(spark):
    flat = _book(spark, [("STARTERS", "s", 0, False), ("MAINS", "m", 0, False)], ["s", "r1", "r2", "m", "r3"], ["r1", "r2", "r3"])
    assert dict(rows(toc.chapter_map(flat), "path", "label")) == {"r1": "STARTERS", "r2": "STARTERS", "r3": "MAINS"}
    deep = _book(
        spark,
        [("Vegetables", "v", 0, True), ("Charring", "c", 1, True), ("Leek", "r1", 2, False), ("Kale", "r2", 2, False), ("Browning", "n", 1, True), ("Root", "r3", 2, False)],
        ["v", "c", "r1", "r2", "n", "r3"], ["r1", "r2", "r3"])
    assert dict(rows(toc.chapter_map(deep), "path", "label")) == {"r1": "Charring", "r2": "Charring", "r3": "Browning"}
    own = _book(spark, [("Vegetables", "v", 0, False), ("Fish & Shellfish", "f", 0, False)], ["v", "f"], ["v", "f"])
    assert dict(rows(toc.chapter_map(own), "path", "label")) == {"v": "Vegetables", "f": "Fish & Shellfish"}


def test_indexed_search_equals_a_scan(spark, tmp_path):
    draw = random.Random(6)
    words = ["aba", "abab", "bab", "b", "a-b", "\U0001f600x", "ÀB", "zz", ""]
    data = [
        (i, " ".join(draw.choices(words, k=draw.randrange(4))), draw.choice([None, "Bab book"]), draw.choices(words, k=draw.randrange(3)),
         [" ".join(draw.choices(words, k=3))], draw.choices(words, k=2), draw.choice(words))
        for i in range(300)
    ]
    schema = "recipe_id bigint, title string, cookbook_title string, ingredient_names array<string>, ingredient_raw array<string>, method_steps array<string>, excerpt string"
    dishes = spark.createDataFrame(data, schema)
    postings.build_postings(dishes, str(tmp_path / "index"))
    for terms in (["abab"], ["ababa", "zz"], ["b"], ["a-", "q"], ["bab b"], ["none"], [], ["zz zz", "aba", "aba"]):
        got = rows(postings.indexed_keyword_score(dishes, str(tmp_path / "index"), terms), "recipe_id", "score", "matched_terms")
        assert sorted(got) == sorted(rows(search.keyword_score(dishes, terms), "recipe_id", "score", "matched_terms"))
    # Only folders of the terms' grams are read.
    plan = postings.candidates(spark, str(tmp_path / "index"), ["abab"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan.split("PartitionFilters: [")[1][:40]


def test_grams_are_numbers_with_lists(spark, tmp_path):
    """No gram is a string that the sort compares; odd characters and marks inside fields keep their grams."""
    fields = ["a\x00b", None, "", "\U0001f600\U0010ffffz", "aaaa"]
    ended = [(f or "") + postings.MARK * 2 for f in fields]
    want = {f[i : i + 3] for f in ended for i in range(len(f) - 2)}
    assert sorted(postings.grams_of(fields).tolist()) == sorted(map(postings.gram_number, want))
    data = [(None, "ab", None, ["c"], None, [None, "d"], ""), (7, "\U0010ffff", "x", [], [], [], None), (8, None, None, None, None, None, None)]
    schema = "recipe_id bigint, title string, cookbook_title string, ingredient_names array<string>, ingredient_raw array<string>, method_steps array<string>, excerpt string"
    dishes = spark.createDataFrame(data, schema)
    postings.build_postings(dishes, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert dict(stored.dtypes)["gram"] == "bigint"
    found = {(i, g) for g, ids in rows(stored, "gram", "recipe_ids") for i in ids}
    assert found == {(i, postings.gram_number(g)) for i, g in [(None, "ab\0"), (None, "b\0\0"), (None, "c\0\0"), (None, "d\0\0"), (7, "\U0010ffff\0\0"), (7, "x\0\0")]}
    for terms in (["\U0010ffff"], ["x"], [""], ["x", "x\0"]):
        got = rows(postings.indexed_keyword_score(dishes.where("recipe_id = 7"), str(tmp_path / "index"), terms), "recipe_id", "score")
        assert got == rows(search.keyword_score(dishes.where("recipe_id = 7"), terms), "recipe_id", "score")


def test_hops_of_many_sources_equal_brute_force(spark):
    """More than 64 sources, so that rows hold full words of bits and there are several blocks."""
    draw = random.Random(9)
    pairs = {tuple(sorted(draw.sample(range(150), 2))) for _ in range(190)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for source in near:
        away, frontier, distance = {source: 0}, [source], 0
        while frontier:
            distance += 1
            frontier = [n for n in {m for x in frontier for m in near[x]} if n not in away]
            away.update(dict.fromkeys(frontier, distance))
        want |= {(source, n, d) for n, d in away.items()}
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src bigint, dst bigint, weight bigint")
    got = rows(network.hop_distances(edges), "source", "node", "distance")
    assert len(got) == len(want) and set(got) == want
    metrics = {r.name: (r.reachable, r.total_distance, r.eccentricity) for r in network.path_metrics(edges).collect()}
    for source in near:
        far = [d for s, _, d in want if s == source and d]
        assert metrics[source] == (len(far), sum(far), max(far))
    assert network.path_metrics(edges.limit(0)).count() == 0


def test_toc_json_of_any_depth(spark):
    deep = "[" + '{"label": "a", "href": "b", "children": [' * 100_000 + "]}" * 100_000 + "]"
    data = [(1, deep), (2, deep[:-1]), (3, "[" * 50_000), (4, '[{"label": "x", "href": "y"}] z'), (5, '[{"label": "\\ud800x", "href": "y"}]')]
    got = toc.toc_flatten(spark.createDataFrame(data, "cookbook_id int, table_of_contents string"))
    counts = {r.cookbook_id: (r["n"], r["deepest"]) for r in got.groupBy("cookbook_id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).collect()}
    assert counts == {1: (100_000, 99_999), 5: (1, 0)}


def test_json_is_read_as_the_library_reads_it():
    draw = random.Random(3)

    def made(depth):
        kind = draw.randrange(7 if depth < 4 else 5)
        if kind < 5:
            return [None, True, draw.random() * 1e6, draw.randrange(-99, 99), 'a"\\é\n]'][kind]
        return [made(depth + 1) for _ in range(draw.randrange(4))] if kind == 5 else {f"k{i}": made(depth + 1) for i in range(draw.randrange(4))}

    def read(reader, source):
        try:
            return True, reader(source)
        except ValueError:
            return False, None

    for _ in range(5000):
        source = json.dumps(made(0), indent=draw.choice([None, 1]))
        if draw.random() < 0.5:
            at = draw.randrange(len(source))
            source = source[:at] + draw.choice('[]{},:"1tnull ') + source[at + draw.randrange(2) :]
        assert read(toc.read_json, source) == read(json.loads, source), source


def test_toc_json_and_best(spark):
    payloads = [
        ("a", '[{"label":"Contents","href":"c","children":[{"label":"Vegetables","href":"v","children":[]},{"label":"Fish","href":"f"}]}, 7, "x"]'),
        ("b", "not json"), ("c", '{"label":"x"}'), ("d", None),
    ]
    books = spark.createDataFrame(payloads, "cookbook_id string, table_of_contents string")
    got = rows(toc.toc_flatten(books).orderBy("cookbook_id", "seq"), "cookbook_id", "depth", "label", "has_children")
    assert got == [("a", 0, "Contents", True), ("a", 1, "Vegetables", False), ("a", 1, "Fish", False)]
    deep = '{"label":"12","href":"h"}'
    for level in range(11, -1, -1):
        deep = f'{{"label":"{level}","href":"h","children":[{deep}]}}'
    broken = deep.replace('"label":"12",', "")
    trees = spark.createDataFrame([("d", f"[{deep}]"), ("e", f'[{broken},{{"label":"x","href":"y"}}]')], "cookbook_id string, table_of_contents string")
    got = rows(toc.toc_flatten(trees).orderBy("cookbook_id", "seq"), "cookbook_id", "depth", "label")
    assert got == [("d", i, str(i)) for i in range(13)] + [("e", 0, "x")]
    good = _book(spark, [("MAINS", "m", 0, False)], ["m", "r1"], ["r1"]).withColumn("candidate", F.lit(2))
    poor = _book(spark, [("Index", "m", 0, False)], ["m", "r1"], ["r1"]).withColumn("candidate", F.lit(1))
    assert rows(toc.best_toc(good.unionByName(poor)), "candidate") == [(2,)]


def test_html_nodes_end_where_their_block_is_closed(spark):
    cases = {
        '<p>a</p><div class="ad">BUY NOW</div><p>b</p>': ["a", "b"],
        "<p>a</p>tail<table><tr><td>cell</td></tr></table><h2>h</h2> x": ["a", "h"],
        "<ul><li>one <p>two</p> three</li><li>four</ul>five": ["one two three", "two", "four"],
        "<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><p>f<div><p>g</div>h</p>i": ["a b c d", "b", "c", "e", "f g h", "g"],
        "<li>a<p>b</p>c</li><li>d<p>e</p>": ["a b c", "b", "d", "e"],
        "<ol><li><p>x</p><p>y</p></li></ol><h2>t<h3>u</h3></p>v": ["x y", "x", "y", "t", "u"],
        "<div><p>open <b>bold<br></div><footer>&copy; foot</footer>": ["open bold"],
        "<p>&frac12; &#189; &#xBD; &eacute; &amp;lt; &nosuch; &#0; a&b &rsquo;</p>": ["½ ½ ½ é &lt; &nosuch; \ufffd a&b ’"],
    }
    for source, texts in cases.items():
        pages = spark.createDataFrame([(1, source)], "page_id bigint, html string")
        assert [r.text for r in html.html_nodes(pages).orderBy("seq").collect()] == texts


def test_html_nodes_keep_text_behind_what_is_inside_them(spark):
    cases = {
        "<p>before <img src='x'> after</p>tail": [("p", "before after"), ("img", "")],
        "<img src='y'>none<p>a<img src='x'>b<div>c</div> d</p>": [("img", ""), ("p", "a b c d"), ("img", "")],
        "<ul><li><div>a</div> b</li>x<li><div><div>c</div>d</div>e<table><tr><td>f</table> g</li></ul>": [("li", "a b"), ("li", "c d e f g")],
        "<div><p>a<div/>b</div>c": [("p", "a b")],
    }
    for source, want in cases.items():
        pages = spark.createDataFrame([(1, source)], "page_id bigint, html string")
        assert [(r.tag, r.text) for r in html.html_nodes(pages).orderBy("seq").collect()] == want


def test_nav_and_ncx(spark):
    nav = ('<nav><ol><li><a href="x.html">Wrong</a></li></ol></nav><nav epub:type="toc"><ol><li><a href="c1.xhtml#a">Dips</a><ol><li><a href="d.xhtml">Deep</a></li></ol></li>'
           '<li><a>No link</a><ol><li><a href="lost.xhtml">Lost</a></li></ol></li><li><a href="c2.xhtml">Hot <b>Meze</b></a></li></ol></nav>')
    pages = spark.createDataFrame([("n", nav)], "page_id string, html string")
    assert rows(html.toc_from_html(pages, base=F.lit("OEBPS/nav.xhtml")), "depth", "label", "href") == [
        (0, "Dips", "OEBPS/c1.xhtml"), (1, "Deep", "OEBPS/d.xhtml"), (0, "Hot Meze", "OEBPS/c2.xhtml")]
    ncx = '<ncx><navMap><navPoint id="1"><navLabel><text>1. Tight for Time</text></navLabel><content src="a.html"/></navPoint></navMap></ncx>'
    files = spark.createDataFrame([("x", ncx), ("bad", "<navPoint>")], "doc string, xml string")
    assert rows(html.toc_from_ncx(files), "doc", "label", "href") == [("x", "1. Tight for Time", "a.html")]


def test_sections_from_toc(spark):
    books = _book(
        spark,
        [("Vegetables", "v", 0, True), ("Charring", "c", 1, True), ("Leek", "r1", 2, False), ("Kale", "r2", 2, False), ("Browning", "n", 1, True), ("Root", "r3", 2, False), ("Beet", "r4", 2, False)],
        [], [])
    dishes = spark.createDataFrame(
        [("b", i, i, f"T{i}", "", f"r{i}#x", "epub", "") for i in range(1, 6)],
        "cookbook_id string, recipe_id int, position int, title string, chapter_title string, anchor string, format string, excerpt string")
    got = dict(rows(toc.section_from_toc(dishes, books), "recipe_id", "section"))
    assert got == {1: "Charring", 2: "Charring", 3: "Browning", 4: "Browning", 5: "Recipes"}


# --- PDF layouts -----------------------------------------------------------------------------

FILE = ("file_id string, file_name string, cookbook_title string, page_width double, page_count int, "
        "blocks array<struct<page:int,x0:double,y0:double,text:string>>, words array<struct<page:int,x0:double,y0:double,text:string>>")


def _file(spark, blocks, width=595.0, pages=2, words=()):
    laid = [(p, float(x), float(y), t) for p, x, y, t in blocks]
    return spark.createDataFrame([("f", "my-dish_recipe.pdf", "Book", width, pages, laid, [(p, float(x), float(y), t) for p, x, y, t in words])], FILE)


def test_nytimes_layout(spark):
    blocks = [
        (1, 40, 60, "Lemon Pasta"), (1, 40, 100, "By Some Cook"), (1, 40, 110, "Published May 1, 2024"), (1, 40, 120, "Updated May 3, 2024"),
        (1, 40, 130, "Total Time 25 minutes"), (1, 40, 150, "Bright and quick."), (1, 40, 200, "INGREDIENTS"), (1, 40, 210, "Yield: 4 servings"),
        (1, 40, 220, "1 pound spaghetti"), (1, 40, 230, "2 lemons"), (1, 40, 240, "FOR SERVING"), (1, 40, 250, "Parmesan"), (1, 250, 200, "PREPARATION"),
        (1, 250, 205, "Salt the water."), (1, 250, 210, "Step 1"), (1, 250, 220, "Boil"), (1, 250, 230, "the pasta."), (2, 250, 40, "Step 2"),
        (2, 250, 50, "Toss."), (2, 250, 60, "TIP"), (2, 250, 70, "Zest first."), (2, 250, 80, "Private Notes here"),
    ]
    r = pdf.pdf_nytimes(_file(spark, blocks)).first()
    assert r["title"] == "Lemon Pasta" and r["reason"] is None
    assert r["metadata"] == {"author": "Some Cook", "published_at": "May 1, 2024", "updated_at": "May 3, 2024", "total_time": "25 minutes", "yield": "4 servings", "intro": "Bright and quick."}
    assert [i["canonical_name"] for i in r["ingredients"]] == ["spaghetti", "lemons"]
    assert r["method_steps"] == ["Boil the pasta.", "Toss."] and r["preparation_notes"] == ["Salt the water."]
    assert [(s["heading"], s["lines"]) for s in r["supplemental_sections"]] == [("For Serving", ["Parmesan"]), ("Tip", ["Zest first."])]


def test_jamie_layout(spark):
    blocks = [
        (1, 30, 50, "EASY BAGELS"), (1, 30, 100, "1 HOUR 20 MINUTES PLUS PROVING TIME"), (1, 30, 115, "NOT TOO TRICKY"), (1, 30, 130, "MAKES 8"), (1, 30, 200, "INGREDIENTS"),
        (1, 30, 220, "500g strong flour, plus"), (1, 30, 230, "extra for dusting"), (1, 30, 240, "1 egg"), (1, 30, 250, "TOP TIP: Rest it."), (1, 30, 260, "Really."),
        (1, 300, 200, "METHOD"), (1, 300, 215, "TO PREP"), (1, 300, 230, "Weigh it all."), (1, 300, 250, "1"), (1, 330, 255, "Mix the flour."), (1, 330, 270, "Knead well."),
        (1, 300, 300, "2"), (1, 330, 306, "Shape them."), (2, 300, 40, "TO COOK 3"), (2, 330, 60, "Boil them."), (2, 300, 90, "Bake until golden. 4"),
    ]
    r = pdf.pdf_jamie(_file(spark, blocks)).first()
    assert r["reason"] is None and r["title"] == "Easy Bagels"
    assert r["metadata"] == {"author": "Jamie Oliver", "total_time": "1 Hour 20 Minutes Plus Proving Time", "difficulty": "Not Too Tricky", "makes": "8"}
    assert [i["raw"] for i in r["ingredients"]] == ["500g strong flour, plus extra for dusting", "1 egg"]
    assert r["method_steps"] == ["Mix the flour. Knead well.", "Shape them.", "Boil them.", "Bake until golden."]
    assert r["preparation_notes"] == ["To Prep Weigh it all. To Cook"]
    assert [s["lines"] for s in r["supplemental_sections"]] == [["Rest it. Really."]]
    missing = pdf.pdf_jamie(_file(spark, [b for b in blocks if b[1] < 300])).first()
    assert missing["reason"].endswith("expected a METHOD section with numbered steps.")


def test_bbc_layout(spark):
    blocks = [
        (1, 30, 100, "Flour tortillas"), (1, 30, 130, "Some Writer"), (1, 30, 160, "Makes 6 Easy"), (1, 30, 180, "Prep: 30 mins Cook: 25 mins"), (1, 30, 200, "plus resting"),
        (1, 30, 230, "Soft wraps."), (1, 30, 270, "Vegan"), (1, 30, 285, "Vegetarian"), (1, 30, 370, "Ingredients"), (1, 30, 400, "250g plain flour, plus extra"),
        (1, 30, 410, "for dusting"), (1, 30, 420, "2 tbsp oil"), (1, 30, 500, "Method"), (1, 30, 520, "Step 1"), (1, 30, 530, "Mix."), (1, 30, 540, "Step 2"), (1, 30, 550, "Roll"),
        (2, 30, 20, "thinly."), (2, 30, 30, "Step 3"), (2, 30, 40, "Cook."),
    ]
    r = pdf.pdf_bbc(_file(spark, blocks)).first()
    assert r["reason"] is None and r["method_steps"] == ["Mix.", "Roll thinly.", "Cook."]
    assert r["metadata"] == {"author": "Some Writer", "makes": "6", "difficulty": "Easy", "prep_time": "30 mins", "cook_time": "25 mins", "intro": "Soft wraps.", "tags": "Vegan|Vegetarian"}
    assert len(r["ingredients"]) == 2 and r["preparation_notes"] == ["plus resting"]


def test_waitrose_layout(spark):
    blocks = [
        (1, 30, 400, "Herby beans"), (1, 30, 480, "Quick."), (1, 30, 600, "Serves 2"), (1, 30, 610, "Course Lunch"), (1, 30, 620, "Prepare 10 mins"), (1, 30, 630, "Cook 10 mins"),
        (1, 30, 640, "Total time 20 mins"), (2, 30, 20, "Ingredients"), (2, 30, 40, "1 tbsp oil"), (2, 300, 40, "400g can beans"), (2, 30, 60, "2 shallots"), (2, 300, 60, "25g pack dill"),
        (2, 30, 100, "Method"), (2, 30, 300, "Nutritional"),
    ]
    words = [(2, 30, 120, "1"), (2, 60, 120, "Heat"), (2, 90, 120, "oil."), (2, 30, 140, "2"), (2, 60, 140, "Add"), (2, 90, 140, "200"), (2, 300, 120, "3"), (2, 330, 120, "Serve."), (2, 30, 320, "9")]
    r = pdf.pdf_waitrose(_file(spark, blocks, words=words)).first()
    assert r["reason"] is None and r["title"] == "Herby beans"
    assert [i["raw"] for i in r["ingredients"]] == ["1 tbsp oil", "2 shallots", "400g can beans", "25g pack dill"]
    assert r["method_steps"] == ["Heat oil.", "Add 200", "Serve."]
    short = pdf.pdf_waitrose(_file(spark, blocks, pages=1)).first()
    assert short["reason"].endswith("expected a 2-page recipe PDF.")


# --- work done once, in tasks of bounded size ------------------------------------------------


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()

def test_runs_do_not_make_their_items_again(spark):
    df = spark.createDataFrame([(["a", "1", "b", "1", "c"],), (None,), ([],)], "a array<string>")
    made = df.select(documents.split_at(F.reverse("a"), lambda x, i: x == "1").alias("r"))
    assert [r["r"] for r in made.collect()] == [[["1", "b"], ["1", "a"]], None, []]
    assert _plan(made).count("reverse(") == 1

def test_waitrose_steps_of_one_number_meet(spark):
    first = [(1, 30, 600, "Serves 2"), (2, 30, 20, "Ingredients"), (2, 30, 40, "1 egg"), (2, 30, 100, "METHOD")]
    words = [(2, 30, 110 + n, t) for n, t in enumerate(["2", "b", "10", "k", "1", "a", "2", "c"])] + [(2, 300, 110, "1"), (2, 310, 111, "d")]
    found = pdf.pdf_waitrose(_file(spark, first, words=words))
    assert found.first()["method_steps"] == ["a d", "b c", "k"]
    # Steps meet by sorting, not by a search for each number.
    assert "array_distinct" not in _plan(found)

def test_gate_reads_its_sections_once(spark):
    lines = "ingredient_lines array<string>, method_lines array<string>"
    df = spark.createDataFrame([(1, ["a"], ["b"]), (2, [], ["b"]), (3, ["a"], []), (4, None, ["b"])], f"recipe_id int, {lines}")
    paths = documents.gate_path(df)
    ready, rest = documents.deterministic_gate(df)
    assert [r["path"] for r in paths.orderBy("recipe_id").collect()][:3] == ["rules", "model", "model"]
    for name, part in (("rules", ready), ("model", rest)):
        assert rows(part, "recipe_id") == rows(paths.where(F.col("path") == name), "recipe_id")
        assert part.columns == df.columns

def test_filters_do_not_make_entries_again(spark):
    lines = spark.createDataFrame([(1, 0, "- soup https://e.org/a"), (1, 1, "- out")], "file_id int, line_no int, line string")
    found = plan.non_recipe_entries(plan.plan_carry_forward(lines))
    assert rows(found, "title") == []
    assert "Generate explode(array(CASE" in _plan(found)


def test_shopping_tasks_grow_in_number_with_the_lines(spark, monkeypatch):
    from larder import session

    monkeypatch.setattr(session, "TASK_ROWS", 2)
    plan_rows = spark.range(60).select(F.lit("w").alias("week_id"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("recipe_id"))
    dishes = spark.range(60).select(F.col("id").alias("recipe_id"), F.lit("Dish").alias("title"))
    none = F.lit(None).cast("string")
    lines = dishes.select("recipe_id", none.alias("canonical_name"), F.lit("lime").alias("normalized_name"), F.lit("1 lime").alias("raw"))
    uses = plan.shopping_uses(plan_rows, dishes, lines)
    assert rows(plan.shopping_list(plan_rows, dishes, lines), "name", "total_uses", "source_count") == [("lime", 40, 40)]
    assert "RepartitionByExpression [recipe_id" in _plan(uses) and ", 30" in _plan(uses)


def test_rounds_do_not_shuffle_the_edges(spark, monkeypatch):
    written = []
    monkeypatch.setattr(network, "cut_lineage", lambda df: written.append(_plan(df)) or df.localCheckpoint())
    edges = spark.createDataFrame([("a", "b", 1), ("c", "d", 1), ("b", "e", 1)], "src string, dst string, weight int")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "name string")
    assert sorted(rows(network.connected_components(nodes, edges), "component", "size")) == [("a", 3), ("c", 2), ("f", 1)]
    assert "Sort [b" in written[0] and "RepartitionByExpression [b" in written[0]


def test_rounds_read_only_the_edges_between_trees(spark, monkeypatch):
    """All pairs of 30 names make one tree, so no round reads an edge; before, both ways of all 435 were written."""
    written = []
    monkeypatch.setattr(network, "cut_lineage", lambda df: written.append(df.count()) or df.localCheckpoint())
    nodes = spark.range(30).select(F.col("id").alias("name"))
    edges = nodes.crossJoin(nodes.select(F.col("name").alias("dst"))).where("name < dst").select(F.col("name").alias("src"), "dst")
    assert rows(network.connected_components(nodes, edges), "component", "size") == [(0, 30)]
    assert written[0] == 0


def test_components_equal_a_search(spark):
    draw = random.Random(3)
    for size, count in ((40, 25), (60, 60), (12, 40)):
        pairs = {tuple(sorted(draw.choices(range(size), k=2))) for _ in range(count)}
        kept = [n for n in range(size) if n % 7]
        # Names without a node, an edge from a name to itself and nulls join nothing.
        edges = spark.createDataFrame([(a, b, 1) for a, b in pairs] + [(None, 1, 1), (2, None, 1)], "src long, dst long, weight long")
        nodes = spark.createDataFrame([(n, 3) for n in [*kept, None]], "name long, frequency long")
        found = {n: n for n in kept}
        for _ in range(size):
            for a, b in pairs:
                if a in found and b in found:
                    found[a] = found[b] = min(found[a], found[b])
        assert dict(rows(network.component_labels(nodes, edges), "name", "component")) == found


def test_stored_rows_leave_no_shuffle_behind(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    df = session.stored(spark.range(50).repartition(3, "id").groupBy((F.col("id") % 5).alias("k")).count())
    assert sorted(rows(df, "k", "count")) == [(k, 10) for k in range(5)] and "Exchange" not in _plan(df)
    assert spark.conf.get(key, None) == before


def test_readers_do_not_hold_the_batches_they_have_read(spark):
    held = []

    def read(frame):
        # A column and its string functions refer to each other; the collector may come at any time later.
        gc.disable()
        texts = frame["t"]
        texts.str.len()
        alive = sum(ref() is not None for ref in held)
        held.append(weakref.ref(texts))
        if frame["id"].max() == 399:
            gc.enable()
        return frame[["id"]].head(1).assign(alive=alive)

    rows_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_a_batch)
    spark.conf.set(rows_a_batch, "10")
    try:
        df = spark.range(0, 400, 1, 1).withColumn("t", F.col("id").cast("string"))
        got = hooks.extract_with(df, read, "id bigint, alive bigint").collect()
    finally:
        spark.conf.set(rows_a_batch, before)
    assert len(got) == 40 and max(r["alive"] for r in got) <= 2
