from pyspark.sql import functions as F

from residuum.functions import paths, sqltext, text
from residuum.operators import cleanup, diff, generator, grading, graph, resolve, symbols


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or ("",)], list(values) or ["x"])
    return row.select(column.alias("v")).first()["v"]


def test_closures_end_on_cycles(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "x", "y"), ("t", "a", "z")], "slug string, src string, dst string")
    roots = spark.createDataFrame([("s", "a"), ("t", "q")], "slug string, node string")
    assert sorted((r["slug"], r["node"]) for r in graph.reachable(roots, edges).collect()) == [("s", "a"), ("s", "b"), ("s", "c"), ("t", "q")]
    assert graph.reachable(roots.limit(0), edges).count() == 0


def test_members_come_from_the_last_trait_first(spark):
    parents = spark.createDataFrame([("s", "k", "old", 1), ("s", "k", "p", 2), ("s", "p", "k", 3)], "slug string, child string, parent string, ord int")
    traits = spark.createDataFrame([("s", "k", "t1", 0), ("s", "k", "t2", 1), ("s", "p", "t3", 0)], "slug string, cls string, trait string, pos int")
    lines = symbols.ancestors(parents, traits)
    order = [r["owner"] for r in lines.filter("cls = 'k'").orderBy("rank").collect()]
    assert order == ["k", "t2", "t1", "p", "t3"]


def test_merge_poisons(spark):
    facts = spark.createDataFrame([("s", "a", "1"), ("s", "a", "1"), ("s", "b", "1"), ("s", "b", "2"), ("s", "c", "1"), ("s", "c", None), ("s", "d", None)], "slug string, name string, value string")
    found = {r["name"]: (r["value"], r["poisoned"]) for r in symbols.merge(facts, ["slug", "name"]).collect()}
    assert found == {"a": ("1", False), "b": (None, True), "c": (None, True), "d": (None, True)}


def test_fold_of_segments(spark):
    def fold(*segments):
        return tuple(one(spark, resolve.fold(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).cast("string").alias("value")) for k, v in segments)))))

    assert fold(("lit", "a"), ("lit", "b")) == ("ab", "verified")
    assert fold(("lit", "a"), ("sym", "b")) == ("ab", "resolved")
    assert fold(("lit", "a"), ("unknown", None), ("lit", "b")) == ("a*", "pattern")
    assert fold(("lit", "a"), ("pattern", "b"), ("lit", "c")) == ("ab*", "pattern")
    assert fold(("unknown", None), ("lit", "b")) == (None, "dynamic") == fold(("lit", ""), ("lit", "x"))
    assert fold(*[("lit", "a")] * 257) == (None, "dynamic")


def test_like_patterns(spark):
    rows = [("acme\\_%", "acme_x", True), ("acme\\_%", "acmeXx", False), ("a_c", "abc", True), ("a_c", "ac", False), ("A%", "abc\nd", True), ("a.c", "abc", False), ("\\%", "%", True), ("x\\", "x\\", True), ("a\\Eb", "aEb", True)]
    df = spark.createDataFrame(rows, "p string, s string, e boolean")
    assert all(r["m"] == r["e"] for r in df.select("e", F.rlike("s", cleanup.like_regex(F.col("p"))).alias("m")).collect())


def test_sql_texts(spark):
    made = lambda s, cut=False: one(spark, sqltext.created(F.col("s"), F.lit(cut)), s=s)
    gone = lambda s, cut=False: one(spark, sqltext.dropped(F.col("s"), F.lit(cut)), s=s)
    rows = lambda s: [tuple(r) for r in one(spark, sqltext.deleted_rows(F.col("s")), s=s)]
    assert made("CREATE TABLE a (x); create table if not exists `b`(y)") == ["a", "b"]
    assert made("INSERT 'CREATE TABLE a'") == [] == made("CREATE TABLE {prefix}cut", True)
    assert made("CREATE TABLE {prefix}cut") == ["{prefix}cut"] and made("CREATE TABLE a (", True) == ["a"]
    assert gone("DROP TABLE IF EXISTS a, `b`,c") == ["a", "b", "c"] and gone("DROP TABLE a, b", True) == ["a"]
    assert gone("DROP TABLE a; DROP TABLE b", True) == ["a"] and gone("DROP TABLE `a`, `b`", True) == ["a", "b"] and gone("DROP TABLE a b, c; drop table d,,e") == ["a", "d"]
    assert made("INSERT INTO x VALUES ('a;b'); CREATE TABLE c (d)") == ["c"] and made("CREATE TABLE a'b") == [] == made("CREATE TABLE") == made("")
    assert rows("delete from `{prefix}options` where (`option_name` like 'it\\'s;%')") == [("option", "it\\'s;%", False)]
    assert rows("DELETE FROM {prefix}options WHERE option_name = 'a' OR") == [] == rows("DELETE FROM {prefix}options WHERE option_name LIKE 'a%' OR x LIKE 'b'")
    assert rows("DELETE FROM {prefix}postmeta WHERE meta_key = 'a_b'") == [("post_meta", "a\\_b", False)]
    assert rows("DELETE FROM {prefix}options WHERE option_name LIKE 'a%' OR option_name = 'b'") == [("option", "a%", False), ("option", "b", False)]
    assert rows("DELETE FROM {prefix}options WHERE option_name LIKE 'a%' AND x = 1") == [] == rows("DELETE FROM {prefix}posts WHERE meta_key = 'a'")


def test_paths_and_headers(spark):
    assert one(spark, paths.normalize(F.col("s")), s="a/./b\\..//c/../../../d") == "d"
    assert one(spark, paths.classify(F.col("s")), s="{content_dir}/DB.php") == "dropin" and one(spark, paths.classify(F.col("s")), s="{content_dir}/x/db.php") is None
    assert one(spark, text.release_header(F.col("s"), "Version"), s="<?php /* Plugin Name: a\r Version: 3 */ ?>") == "3"
    assert one(spark, text.header_field(F.col("s"), "Version"), s="<?php /* Version: 3 */") is None


def test_generator(spark):
    key = lambda s: one(spark, generator.key_expression(F.col("s")), s=s)
    assert key("it's") == "'it\\'s'" and key("{prefix}logs") == "$wpdb->prefix . 'logs'" and key("a{prefix}b") == "'a' . $wpdb->prefix . 'b'" and key("{x}") == "'{x}'"
    rows = [("s", 1, t, fn, k, "verified", False, args) for t, fn, k, args in [
        ("option", "update_option", "a", False), ("option", "update_site_option", "n", False), ("table", "dbDelta", "{prefix}t", False), ("cron", "x", "h", False), ("cron", "x", "h", True),
        ("user_meta", "x", "u", False), ("user_meta", "x", "{prefix}u", False), ("capability", "x", "c?>\nevil();", False), ("dropin", "x", "{content_dir}/db.php", False), ("post_type", "x", "pt", False), ("option", "x", "siteurl", False),
    ]]
    findings = spark.createDataFrame(rows, "slug string, ord int, type string, function string, key string, confidence string, cleaned boolean, has_args boolean")
    body = generator.teardown(findings, spark.createDataFrame([("s", "My */ Plugin\n")], "slug string, plugin_name string")).first()["text"]
    for line in ("    delete_option('a');", "delete_site_option('n');", "    wp_unschedule_hook('h');", "    delete_metadata('user', 0, $wpdb->prefix . 'u', '', true);", "delete_metadata('user', 0, 'u', '', true);", '// - post type "pt"'):
        assert line in body.split("\n"), line
    assert "siteurl" not in body and "wp_clear_scheduled_hook" not in body and "\nevil" not in body and "?>" not in body and "*/ Plugin" not in body


def test_worse_grades_and_coverage(spark):
    worse = lambda a, b: one(spark, diff.worse_grade(F.col("a"), F.col("b")), a=a, b=b)
    assert worse("A", "B") and worse("D", "F") and not worse("B", "A") and not worse("?", "F")
    dropped = lambda *v: one(spark, diff.coverage_dropped(*(F.lit(x) for x in v)), x=1)
    assert dropped(0.9, 0.899, 0, 0) and dropped(0.9, 0.9, 0, 1) and not dropped(0.9, 0.8999, 0, 0) and not dropped(None, 0.1, None, 3)


def test_scores(spark):
    rows = [("s", k, "option", "update_option", f"k{k}", "verified", "yes", False) for k in range(20)] + [("c", 1, "option", "x", "a", "verified", None, False), ("c", 2, "option", "x", "a", "verified", "yes", True)]
    findings = spark.createDataFrame(rows, "slug string, ord int, type string, function string, key string, confidence string, autoload string, cleaned boolean")
    flags = spark.createDataFrame([("s", True, False), ("c", True, True), ("none", False, False)], "slug string, has_path boolean, conditional boolean")
    found = {r["slug"]: (r["letter"], r["score"], r["n_left"]) for r in grading.grade(findings, flags).collect()}
    assert found == {"s": ("D", 0, 20), "c": ("D", 65, 1), "none": ("A", 100, 0)}
