import itertools
import json
import random
import re

from pyspark.sql import functions as F

from glossaflow.functions import text
from glossaflow.operators import display_forms, messages
from glossaflow.sources import json_walk, scripts


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} STRING" for n in names))
    return df.select(make(*map(F.col, names)).alias("x")).first()["x"]


def test_candidates(spark):
    rows = [("設定", "ja", True), ("ボス", "ja", True), ("img/a.png", "ja", False), ("res://設定", "ja", False), ("　 ", "ja", False), (None, "ja", False)]
    rows += [("Hello there", "en", True), ("Start", "en", False), ("item_name.x", "en", False), ("한글", "ko", True), ("abc", "zh", False)]
    for value, lang, expected in rows:
        assert one(spark, lambda c, lang=lang: text.is_candidate(c, lang), value) is expected, value


def test_target_errors(spark):
    rows = [
        ("Hi {name}", "Salut {name}", []),
        ("Hi {name}", "Salut", ["tokens"]),
        ("a\nb", "ab", ["line_feeds"]),
        (" a", "a", ["edge_space"]),
        ("a", "　", ["empty"]),
        ("a", None, ["empty"]),
        ("%d of %s", "%s sur %d", []),
        ("a\tb\r", "ab", ["tabs", "returns", "edge_space"]),
        ("　a", " a", []),
    ]
    for source, target, expected in rows:
        assert one(spark, text.target_errors, source, target) == expected, (source, target)
    code = r"\\[A-Za-z]+\[[^\]\n]*\]"
    assert one(spark, lambda s, t: text.target_errors(s, t, (code,)), r"\C[1]x", r"\C[1]y") == []
    assert one(spark, lambda s, t: text.target_errors(s, t, (code,)), r"\C[1]x", "y") == ["tokens"]


def test_escapes(spark):
    for value in ("a=b", "// note", "tab\there\nline\r", "back\\slash", ""):
        entry = one(spark, lambda c: F.concat(text.escape_entry(c), F.lit("="), text.escape_entry(c)), value)
        left, right = (one(spark, lambda c, n=n: text.unescape_entry(text.split_entry(c)[n]), entry) for n in (0, 1))
        assert left == right == value
    assert one(spark, lambda c: text.split_entry(c)[0], "no equals") is None
    assert one(spark, text.json_literal, r"a\"b\u0041") == 'a"bA'


def test_small_functions(spark):
    assert one(spark, text.segments, r"a：b/[x]c<d>\C[1] e| ") == ["a", "b", "c", "e"]
    assert one(spark, text.join_cjk, "あ い a あ") == "あい a あ"
    assert [one(spark, lambda c: text.matches_any(c, ["save/*", "*.log"]), p) for p in ("save/a/b", "x/y.log", "keep.txt")] == [True, True, False]
    assert [one(spark, text.is_safe_path, p) for p in ("a/b", "../a", "/a", "c:/a", "a\\b", "a//b")] == [True, False, False, False, False, False]
    assert [one(spark, text.is_safe_literal, t, '"') for t in ('a', 'a"b', 'a\\"b', "a\nb", "a'b")] == [True, False, True, False, True]
    assert [one(spark, lambda c, n=n: text.retry_delay(F.lit(n)), "") for n in (0, 1, 2, 5, 9)] == [30, 30, 60, 300, 300]


SCENARIO = "#Hero\nHello [r]there\n; note\n*label\n[iscript]\nvar a = 'x';\n[endscript]\n[button text=\"Go on\" jname='N' x=1]\n@cmd\n  Spaced  \n"


def test_scenario_units_and_putting_back(spark):
    texts = spark.createDataFrame([(1, SCENARIO), (2, None)], "seq BIGINT, text STRING")
    got = sorted((r["line"], r["kind"], r["start"], r["end"], r["source"]) for r in scripts.scenario_units(texts).collect())
    assert got == [(0, "speaker", 1, 5, "Hero"), (1, "text", 0, 14, "Hello [r]there"), (7, "attr:jname", 28, 29, "N"), (7, "attr:text", 14, 19, "Go on"), (9, "text", 2, 8, "Spaced")]
    known = spark.createDataFrame([("Hero", "Held"), ("Go on", "Weiter"), ("N", "M"), ("Spaced", "Spaced")], "source STRING, target STRING")
    row = scripts.apply_units(texts.where("seq = 1"), known).first()
    assert row["text"] == SCENARIO.replace("Hero", "Held").replace("Go on", "Weiter").replace("'N'", "'M'") and row["n_edits"] == 3


def test_literals(spark):
    code = "var a = \"one\"; // \"no\"\nb = 'tw\\'o' /* \"x\" */ + @\"skip\" + \"open\n + \"three\";"
    texts = spark.createDataFrame([(1, code)], "seq BIGINT, text STRING")
    assert [r["source"] for r in scripts.string_literals(texts).orderBy("start").collect()] == ["one", "tw\\'o", "three"]
    known = spark.createDataFrame([("one", "uno"), ("three", 'bad"')], "source STRING, target STRING")
    row = scripts.apply_literals(texts, known).first()
    assert row["text"] == code.replace("one", "uno") and (row["n_edits"], row["n_unsafe"]) == (1, 1)


def test_display_fields(spark):
    files = {
        "Actors.json": [None, {"name": "Hero", "profile": "A hero.", "note": "x"}],
        "System.json": {"gameTitle": "Game", "elements": ["", "Fire"], "terms": {"basic": ["HP"], "messages": {"win": "You won"}}},
        "Map001.json": {"displayName": "Town", "events": [{"pages": [{"list": [{"code": 401, "parameters": ["Hi"]}, {"code": 101, "parameters": ["", 0, 0, 2, "Bob"]}, {"code": 102, "parameters": [["Yes", "No"], 1]}, {"code": 355, "parameters": ["Hero()"]}]}]}]},
    }
    docs = spark.createDataFrame([(k, "﻿" + json.dumps(v)) for k, v in files.items()], "file STRING, text STRING").select("file", json_walk.parsed(F.col("text")).alias("value"))
    got = {(r["file"], r["path"], r["text"], r["kind"]) for r in json_walk.display_fields(docs).collect()}
    assert got == {
        ("Actors.json", "1/name", "Hero", "name"), ("Actors.json", "1/profile", "A hero.", "text"), ("System.json", "gameTitle", "Game", "name"),
        ("System.json", "elements/0", "", "name"), ("System.json", "elements/1", "Fire", "name"), ("System.json", "terms/basic/0", "HP", "name"), ("System.json", "terms/messages/win", "You won", "text"),
        ("Map001.json", "displayName", "Town", "name"), ("Map001.json", "events/0/pages/0/list/0/parameters/0", "Hi", "text"), ("Map001.json", "events/0/pages/0/list/1/parameters/4", "Bob", "name"),
        ("Map001.json", "events/0/pages/0/list/2/parameters/0/0", "Yes", "text"), ("Map001.json", "events/0/pages/0/list/2/parameters/0/1", "No", "text"),
    }
    corpus = spark.createDataFrame([("x = Hero();",)], "text STRING")
    hints = {r["source"]: r["hint"] for r in json_walk.occurrences(docs, corpus, "en").collect()}
    assert hints["A hero."] == "display" and "Hero" not in hints  # an identifier is no English candidate


PAIRS = [(0, "{name} found %d coins", "{name} fand %d Münzen"), (1, "Open the door", "Öffne die Tür"), (2, "same", "same"), (3, "%s", "%s!"), (4, "Hi {who} and {who}", "Hallo {who}")]


def test_message_rules(spark):
    pairs = spark.createDataFrame(PAIRS, "pair_id BIGINT, source STRING, target STRING")
    rules = {r["rule_id"]: r for r in messages.compile_rules(pairs).collect()}
    assert set(rules) == {0, 1, 4} and rules[0]["specificity"] == len(" found  coins") and "\\1" in rules[4]["pattern"]
    texts = spark.createDataFrame([(1, "Bob found 3 coins"), (2, "Open the door"), (3, "Now: Open the door!"), (4, "nothing"), (5, "Hi A and A"), (6, "Hi A and B"), (7, None)], "seq BIGINT, text STRING")
    got = {r["seq"]: r["target"] for r in messages.rewrite(texts, pairs).collect()}
    assert got == {1: "Bob fand 3 Münzen", 2: "Öffne die Tür", 3: "Now: Öffne die Tür!", 4: None, 5: "Hallo A", 6: None, 7: None}


def test_scenario_blocks_and_awkward_lines(spark):
    text = "[html]<b>\n#no\n[endscript]\n[endhtml] rest\n[iscript] x [endscript]\n  #  \n#A b \r\n[a][b text='q ]' jname=\"\"]\n\n@iscript\nopen to the end"
    texts = spark.createDataFrame([(1, text), (2, ""), (3, "\n\nlast line")], "seq BIGINT, text STRING")
    got = sorted((r["seq"], r["line"], r["kind"], r["start"], r["end"], r["source"]) for r in scripts.scenario_units(texts).collect())
    assert got == [
        (1, 4, "text", 0, 23, "[iscript] x [endscript]"), (1, 6, "speaker", 1, 4, "A b"), (1, 7, "text", 0, 26, "[a][b text='q ]' jname=\"\"]"), (3, 2, "text", 0, 9, "last line"),
    ]
    long = "\n".join(["[iscript]", *["code();"] * 30_000, "[endscript]", *[f"line {i}" for i in range(3_000)]])
    found = scripts.scenario_units(spark.createDataFrame([(1, long)], "seq BIGINT, text STRING")).agg(F.count("*"), F.min("line"), F.max("line")).first()
    assert tuple(found) == (3_000, 30_002, 33_001)


def test_occurrences_of_scripts(spark):
    files = spark.createDataFrame([("data/a.ks", "#太郎\n【花子】\n本文[r]です\n[b text='選択']\nplain"), ("x/Startup.tjs", 'a = "開始"; b = "abc";'), ("x/main.tjs", "c = '設定'")], "path STRING, text STRING")
    got = {(r["source"], r["ref"], r["context"], r["hint"]) for r in scripts.scenario_occurrences(files.where("path LIKE '%.ks'")).collect()}
    assert got == {("太郎", "data/a.ks:1", "speaker", "unknown"), ("【花子】", "data/a.ks:2", "speaker", "display"), ("本文[r]です", "data/a.ks:3", "text", "display"), ("選択", "data/a.ks:4", "attr:text", "unknown")}
    assert {r["hint"] for r in scripts.scenario_occurrences(files.where("path LIKE '%.ks'"), attributes_shown=True).where("context LIKE 'attr%'").collect()} == {"display"}
    got = {(r["source"], r["ref"], r["hint"]) for r in scripts.literal_occurrences(files.where("path LIKE '%.tjs'")).collect()}
    assert got == {("開始", "x/Startup.tjs@5", "protected"), ("設定", "x/main.tjs@5", "unknown")}


def test_script_corpus(spark):
    files = spark.createDataFrame([("js/rpg_core.js", "no"), ("js/rmmz_x.js", "no"), ("js/plugins/A.js", "own"), ("data/x.json", "no")], "path STRING, text STRING")
    events = {"list": [{"code": 355, "parameters": ["Hero()"]}, {"code": 401, "parameters": ["shown"]}, {"code": 122, "parameters": [1, ["deep"]]}]}
    leaves = json_walk.leaves(spark.createDataFrame([("Map1", json.dumps(events))], "file STRING, text STRING").select("file", json_walk.parsed(F.col("text")).alias("value")))
    assert sorted(r["text"] for r in scripts.script_corpus(files, leaves).collect()) == ["Hero()", "deep", "own"]


def test_running_sums_and_edits(spark):
    numbers = list(range(1000))
    got = spark.range(1).select(text.running_sums(F.lit(numbers).cast("array<int>"), 7).alias("x"), text.running_sums(F.array().cast("array<int>")).alias("none")).first()
    assert got["x"] == [sum(numbers[:i]) for i in numbers] and got["none"] == []
    value = "é1 b22 " * 2000
    found = one(spark, lambda c: text.located(c, "[0-9]+"), value)
    assert [(x["start"], x["end"], x["value"]) for x in found][:2] == [(1, 2, "1"), (4, 6, "22")] and len(found) == 4000
    assert all(value[x["start"] : x["end"]] == x["value"] for x in found)
    put = one(spark, lambda c: text.put_back(c, F.transform(text.located(c, "[0-9]+"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("#").alias("put")))), value)
    assert put == "é# b# " * 2000


def test_aliases(spark):
    assert one(spark, display_forms.FORMS["double_markup"].shown, "a **b** [[c]]((d))") == (
        "a [color={__style_0_ink}]b[/color] [bgcolor={__style_1_bg}][color={__style_1_ink}][font_size={__style_1_size}] c [/font_size][/color][/bgcolor]"
        "[bgcolor={__style_2_bg}][color={__style_2_ink}][font_size={__style_2_size}] d [/font_size][/color][/bgcolor]"
    )
    tone = "[color={__narration}]"
    assert one(spark, display_forms.FORMS["quote_narration"].shown, "x「y」z\n“q”") == f"{tone}x[/color]「y」{tone}z[/color]\n“q”"
    assert one(spark, display_forms.FORMS["quote_narration"].shown, "plain") == "plain"
    pairs = spark.createDataFrame([(0, "a **b**", "A **B**"), (1, "plain", "Plain"), (2, "he「hi」", "no quotes")], "pair_id BIGINT, source STRING, target STRING")
    got = {(r["pair_id"] // messages.ALIAS_STEP, r["target"]) for r in messages.with_aliases(pairs, ("double_markup", "quote_narration")).where("pair_id > 9").collect()}
    assert got == {(1, "A [color={__style_0_ink}]B[/color]"), (2, f"{tone}no quotes[/color]")}
    shown = spark.createDataFrame([(1, "a [color=#fff]b[/color]")], "seq BIGINT, text STRING")
    assert messages.rewrite(shown, pairs, ("double_markup",)).first()["target"] == "A [color=#fff]B[/color]"


def test_forms_equal_plain_functions(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["**", "[[", "]]", "((", "))", "「", "」", "“", "”", "a", "b c", "\n", "*"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    box = "[bgcolor={__style_%d_bg}][color={__style_%d_ink}][font_size={__style_%d_size}] %s [/font_size][/color][/bgcolor]"

    def emphasis(text):
        places = itertools.count()

        def put(m):
            n = next(places)
            return f"[color={{__style_{n}_ink}}]{m[0][2:-2]}[/color]" if m[0].startswith("**") else box % (n, n, n, m[0][2:-2])

        return re.sub(r"\*\*.+?\*\*|\[\[.+?\]\]|\(\(.+?\)\)", put, text)

    def narration(text):
        if not set(text) & set("「“"):
            return text
        parts = [re.split("(「[^」]*」|“[^”]*”)", line) for line in text.split("\n")]
        return "\n".join("".join(x if not x or x[0] in "「“" else "[color={__narration}]" + x + "[/color]" for x in line) for line in parts)

    shown = {name: form.shown(F.col("t")) for name, form in display_forms.FORMS.items()}
    for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", *[c.alias(n) for n, c in shown.items()]).collect():
        assert r["double_markup"] == emphasis(r["t"]) and r["quote_narration"] == narration(r["t"])


def test_display_rewrite(spark):
    pairs = [
        ("剣", "Sword"), ("盾", "Shield"), ("炎の剣", "Flame Sword"), ("{name}は{item}を手に入れた", "{name} got {item}"), ("%d個", "%d pcs"), ("攻撃", "Attack"), ("剣・盾", "Arms"),
        ("勇者", "Hero"), ("開始", "Start"), ("100%%{x}まで", "up to 100%% {x}"),
    ]
    df = spark.createDataFrame([(n, s, t) for n, (s, t) in enumerate(pairs)], "pair_id BIGINT, source STRING, target STRING")
    cases = {
        "剣": "Sword",
        "勇者は剣を手に入れた": "Hero got Sword",
        "[color=red]勇者[/color]は炎の剣を手に入れた": "[color=red]Hero[/color] got Flame Sword",
        "[img]剣[/img]　盾": "[img]剣[/img]　Shield",
        "開\n始": None,  # two lines are no word written downwards
        "勇\n者": None,
        "炎\nの\n剣": "F\nl\na\nm\ne\n \nS\nw\no\nr\nd",
        "> 開始": "> Start",
        "剣・盾・炎の剣": "Arms・Flame Sword",
        "剣・未知": None,
        "3個": "3 pcs",
        "100%終わりまで": None,  # the anchor is the doubled sign, which shown text lacks
        "勇者は剣を手に入れた\n未知\n盾": "Hero got Sword\n未知\nShield",
        "nothing here": None,
        "": None,
    }
    texts = spark.createDataFrame([*enumerate(cases), (99, None)], "seq BIGINT, text STRING")
    got = {r["text"]: r["target"] for r in messages.rewrite(texts, df, prefixes=("> ",)).collect()}
    assert got == cases | {None: None}
