"""Review operators on small rows."""

from pyspark.sql import functions as F

from siltstone.operators import review


def test_json_in_text(spark):
    t = ['{"findings": [{"a": 1}]}', 'Here:\n```json\n{"risks": [1, 2]}\n```', 'so {"vulnerabilities": []} it is', "[1, 2, 3]", "none", None, ""]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, t string")
    n = {r.i: r.n for r in d.select("i", F.size(review.answer_findings(review.json_in(F.col("t")))).alias("n")).collect()}
    assert [n[i] for i in range(4)] == [1, 2, 0, 3] and all(n[i] in (None, -1) for i in (4, 5, 6))


def test_commented_json_and_lookup(spark):
    d = spark.createDataFrame([('// c\n{"a": "http://x"}', "zh", "LOW"), ('{"a": "y"}', "zh", "HIGH")], "t string, l string, s string")
    r = d.select(review.commented_json(F.col("t"), "a string")["a"].alias("a"), review.recommendation(F.col("l"), F.col("s")).alias("r")).collect()
    assert [x.a for x in r] == ["http://x", "y"] and [x.r for x in r] == ["No action needed.", "使用前请审核。"]


FOUND = "finding_id long, rule_id string, severity string, category string, title string, description string, pkg_id string, file_path string, line_number int, source string"


def test_answers_pair_by_position(spark):
    f = spark.createDataFrame([(i, "r", "HIGH", "c", "t", "d", "p", None, 1, "s") for i in range(3)] + [(9, "r", "HIGH", "c", "t", "d", "q", "f", 1, "s")], FOUND)
    b = review.batches(f)
    r = spark.createDataFrame([("p", None, 0, '```json\n[{"verdict": "TP", "confidence": 0.9, "true_severity": "LOW"}, {}]\n```'), ("q", "f", 0, "no array"), ("z", "f", 0, "[1]")], "pkg_id string, file_path string, batch_no int, text string")
    got = {x.finding_id: (x.verdict, x.verdict_confidence, x.true_severity) for x in review.answers(r, b).collect()}
    assert got == {0: ("TP", 0.9, "LOW"), 1: ("HUMAN_REVIEW", 0.5, None), 2: ("UNCERTAIN", 0.5, None), 9: ("UNCERTAIN", 0.5, None)}


def test_results_pair_by_rule_or_title(spark):
    f = spark.createDataFrame([(5, "NET_001", "HIGH", "c", "plain", "d", "p", None, 1, "s"), (3, "X", "LOW", "c", "about NET_", "d", "p", None, 1, "s")], FOUND)
    r = spark.createDataFrame([(1, "p", "NET_"), (2, "p", "NET_001"), (3, "q", "NET_")], "result_id int, pkg_id string, answer_id string")
    assert {x.result_id: x.finding_id for x in review.paired(r, f).collect()} == {1: 3, 2: 5, 3: None}


def test_reports(spark, tmp_path):
    from siltstone.operators import reports

    s = spark.createDataFrame([("a<b", 90, 2, 1, 0, "EXTREME"), ("z", 0, 0, 0, 0, "LOW"), ("m", 30, 1, 0, 1, "MEDIUM")], "pkg_id string, score int, n_findings long, n_critical long, n_high long, level string")
    assert [r["pkg_id"] for r in reports.listing(s)] == ["a<b", "m", "z"] and "a&lt;b" in reports.to_html(s)
    assert {r.pkg_id: r.summary for r in reports.summary_sentence(s).collect()}["m"] == "1 findings: 1 high. Review before installing."
    reports.write_report(s, str(tmp_path / "r"), "json")
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    f = spark.createDataFrame([(1, "r", "HIGH", "c", "t", "d", "p", "a.py", 2, "s")], FOUND)
    assert reports.histogram(f).startswith("HIGH")
    files = spark.createDataFrame([(7, "p", "a.py", "one\ntwo\nthree")], "file_id long, pkg_id string, rel_path string, text string")
    assert "two" in reports.deep_review_task(f, files) and reports.deep_review_task(f.limit(0), files) == "[]"
    ctx = files.select(review.code_context(F.col("text"), F.lit(2), 1).alias("c")).head().c
    assert ctx == "    1: one\n>>> 2: two\n    3: three"


def test_caches(spark):
    from siltstone.operators import state

    c = spark.createDataFrame([(1, "/s/a/", "{}", 10.0), (2, "/s/a", '{"x": 1}', 20.0), (3, "/s/b", "{", 30.0), (4, None, "{}", 40.0), (5, "/s/c", None, None)], "entry_id long, skill_path string, result string, entry_timestamp double")
    assert [(r.skill_path, r.entry_id) for r in state.cache_get(c).collect()] == [("/s/a", 2)]
    assert state.cache_expire(c, 20.0 + 7 * 86400).count() == 3
    assert {r.entry_id for r in state.cache_invalidate(c, spark.createDataFrame([("/s/a",)], "skill_path string")).collect()} == {3, 4, 5}
    assert state.cache_statistics(c).head().n_unreadable == 2 and state.cache_statistics(c.limit(0)).head().n_bytes == 0


def test_trusted_lists(spark, tmp_path):
    from siltstone.operators import reports, trusted

    p = str(tmp_path / "w.json")
    assert trusted.read_lists(p) == {k: [] for k in trusted.SETS}
    trusted.write_lists({"trusted_domains": ["b.org", "a.org"], "exempt_rules": ["R1"]}, p)
    lists = trusted.read_lists(p)
    assert lists["trusted_domains"] == ["a.org", "b.org"] and lists["safe_paths"] == []
    d = spark.createDataFrame([("x.A.org", "os.walk", "tests/a.py"), ("xa.org", "walk", "src/a.py"), (None, None, None)], "d string, f string, p string")
    r = d.select(trusted.domain_trusted(F.col("d"), ["a.org"]), trusted.function_safe(F.col("f"), ["walk"]), trusted.path_safe(F.col("p"), ["tests/*"])).collect()
    assert [tuple(x) for x in r] == [(True, True, True), (False, True, False), (False, False, False)]
    f = spark.createDataFrame([("R1",), ("R2",)], "rule_id string")
    assert [x.rule_id for x in trusted.without_exempt(f, ["R1"]).collect()] == ["R2"] and trusted.without_exempt(f, []).count() == 2
    k = spark.createDataFrame([("reverse_shell",), ("x",)], "k string")
    assert [x.title for x in k.select(*reports.remedy(F.col("k"))).collect()] == ["Reverse shell", None]
