import pytest
from pyspark.sql import functions as F

from quernstone.config import Settings
from quernstone.functions import cost, encoders, text
from quernstone.functions.ids import uuid5
from quernstone.functions.vectors import dot, normalised


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "plain"),
    [
        ("<p>Krok 1</p><p>Krok 2</p>", "Krok 1\nKrok 2"),
        ("Pierwsza<br />Druga", "Pierwsza\nDruga"),
        ("Wpisz &lt;p&gt; w polu", "Wpisz <p> w polu"),
        ("a</div></div></div></div>b", "a\n\nb"),
        ("&amp;lt;", "&lt;"),
        ("", ""),
    ],
)
def test_strip_html(spark, raw, plain):
    assert one(spark, text.strip_html(F.lit(raw))) == plain


def test_strip_html_is_null_safe_and_can_drop_scripts(spark):
    assert one(spark, text.strip_html(F.lit(None).cast("string"))) is None
    assert one(spark, text.strip_html(F.lit("<script>x</script>a<style>b{}</style>"), drop_scripts=True)) == "a"


def test_full_entity_table(spark):
    assert one(spark, text.strip_html(F.lit("Dzie&#324; &eacute;"), entities=text.unescape_all)) == "Dzień é"


def test_measured_variant(spark):
    assert one(spark, text.strip_html_to_measure(F.lit("<p>Dzień dobry,</p>\r\n<ol><li>Krok  pierwszy</li></ol>"))) == "Dzień dobry,\n- Krok pierwszy"
    assert one(spark, text.strip_html_to_measure(F.lit(None).cast("string"))) == ""


def test_thread_chars(spark):
    comments = F.array(F.struct(F.lit("<p>Komentarz</p>").alias("body")))
    assert one(spark, text.thread_chars(F.lit("<p>Opis</p>"), comments)) == 13


def test_thread(spark):
    comment = "struct<kind:string,role:string,created_at:string,body:string>"
    row = spark.createDataFrame([("7", "2026-06-23", "T", "", [("zwyczajny", "klient", "2026", "")], None)], f"i string, d string, s string, b string, c array<{comment}>, n array<{comment}>")
    args = (F.col("i"), F.to_date("d"), F.col("s"), F.col("b"))
    full, bare = row.select(text.render_thread(*args, F.col("c")), text.render_thread(*args, F.col("n"))).first()
    assert full == "ZGŁOSZENIE 7 z 2026-06-23\nTemat: T\n\nOPIS ZGŁASZAJĄCEGO:\n(brak opisu)\n\nKOMENTARZ 1 — klient, 2026 (typ: zwyczajny):\n(pusty komentarz)"
    assert bare.endswith("\n\n(brak komentarzy w wątku)")


@pytest.mark.parametrize(("seconds", "shown"), [(42.4, "42s"), (89.6, "90s"), (125.0, "2min 05s"), (3847.2, "1h 04min"), (3600.0, "1h 00min"), (0.0, "0s"), (0.5, "0s"), (1.5, "2s")])
def test_duration(spark, seconds, shown):
    assert one(spark, text.format_duration(F.lit(seconds))) == shown


def test_fence_prompt_vocabulary(spark):
    assert one(spark, text.strip_fence(F.lit('```JSON\n{"a": 1}\n```\n'))) == '{"a": 1}'
    assert one(spark, text.parse_prompt("V {{vocabulary}} T {{thread}}", F.lit("{{vocabulary}}"), F.lit("v {{thread}}"))) == "V v {{vocabulary}} T {{vocabulary}}"
    assert one(spark, text.render_vocabulary(F.array(F.struct(F.lit("a").alias("name"), F.lit("b").alias("hint"))))) == "- a: b"
    assert one(spark, text.strip_editorial(F.lit("a<!-- x\ny -->\n b"))) == "ab"
    assert text.section("## A\nx\n\n## B\ny", "## A") == "x"


def test_point_id(spark):
    assert one(spark, uuid5(F.lit("33644"))) == "df3b51f3-9eac-56f3-9f28-6253f23dd731"


def test_pseudo_vector(spark):
    want = [-0.6217898978404582, -0.715272348583971, -0.16192790798410245, -0.2748493094599569]
    assert encoders.pseudo_vector("Drukarka nie drukuje po aktualizacji sterownika", 4) == pytest.approx(want, abs=1e-15)
    v = one(spark, encoders.embed_passage(F.lit("Drukarka nie drukuje po aktualizacji sterownika"), encoders.encoder_named(" FAKE ", 4), 4))
    assert v == pytest.approx(want, abs=1e-12)
    with pytest.raises(encoders.EncoderError):
        encoders.encoder_named("none", 4)
    with pytest.raises(encoders.EncoderError):
        encoders.with_prefix(F.lit("x"), "other")


def test_modes_put_prefixes(spark):
    assert [one(spark, encoders.with_prefix(F.lit("x"), m)) for m in encoders.MODES] == ["[query]: x", "x", "[sts]: x"]


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, normalised(v)) == [0.6, 0.8]
    assert one(spark, dot(v, v)) == 25.0
    assert one(spark, normalised(F.array(F.lit(0.0)))) == [0.0]


PRICES = [("added", "small-1", 1.00, 5.00), ("inside", "mini-2", 0.75, 4.50), ("own", "self-hosted", 0.00, 0.00)]


@pytest.mark.parametrize(
    ("model", "prompt", "completion", "write", "read", "usd"),
    [
        ("small-1-20260101", 10**6, 10**6, 0, 0, 6.0),
        ("small-1", 0, 0, 10**6, 10**6, 1.35),
        ("mini-2-2026-03-17", 10**6, 10**6, 0, 0, 5.25),
        ("mini-2", 10**6, 0, 0, 10**6, 0.075),
        ("self-hosted", 10**6, 10**6, 0, 0, 0.0),
    ],
)
def test_cost(spark, model, prompt, completion, write, read, usd):
    calls = spark.createDataFrame([(model, prompt, completion, write, read)], "model string, prompt_tokens long, completion_tokens long, cache_write_tokens long, cache_read_tokens long")
    assert cost.priced(calls, cost.price_table(spark, PRICES)).first()["cost_usd"] == pytest.approx(usd)


def test_cost_is_never_negative_and_unknown_models_fail(spark):
    schema = "model string, prompt_tokens long, completion_tokens long, cache_write_tokens long, cache_read_tokens long"
    assert cost.priced(spark.createDataFrame([("mini-2", 100, 0, 0, 5000)], schema), cost.price_table(spark, PRICES)).first()["cost_usd"] >= 0
    with pytest.raises(cost.PriceError):
        cost.priced(spark.createDataFrame([("other", 1, 1, 0, 0)], schema), cost.price_table(spark, PRICES))


def test_completion_keeps_rows(spark):
    out = encoders.completed(spark.createDataFrame([("a b",), (None,)], "p string"), "p", encoders.fixed_completer("x y z"))
    assert sorted(r["completion"]["prompt_tokens"] for r in out.collect()) == [0, 2]


def test_settings_blank_is_default():
    assert Settings.load({"RAG_TOP_K": " ", "RAG_SCORE_MIN": "0.5"}) == Settings(rag_score_min=0.5)


def test_entities_equal_pythons(spark):
    import html
    import random

    draw = random.Random(4)
    names = sorted(html.entities.html5)
    odd = ["&", "&&amp;", "&#", "&#;", "&#x;", "&#x80;", "&#128", "&#0;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#x000041", "&#11;", "&#13;", "&notit;", "&ampx", "&AMP", "&lt&gt", "&Ksi;&eacute;&#322;&#261;d", "a&b;c", "&nosuch;", "&" + "a" * 40 + ";", "&#xFDD0;", "&#x1F600;", "&sup1x", "&amp;lt;"]
    rows = odd + ["".join(draw.choice(["&" + draw.choice(names), "&" + draw.choice(names)[:-1], f"&#{draw.randrange(70000)};", f"&#x{draw.randrange(1200000):x}", "x ", ";", "é&", "\n"]) for _ in range(8)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in [*rows, None]], "t string")
    got = [tuple(r) for r in df.select("t", text.unescape(F.col("t")), text.unescape_all(F.col("t"))).collect()]
    assert [(t, a) for t, a, _ in got if t is not None and a != html.unescape(t)] == []
    assert all(a == b for _, a, b in got) and got[-1] == (None, None, None)


def test_script_of_answers_ends(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    out = encoders.completed(rows, "p", encoders.scripted_completer(["x", "y z"])).collect()
    assert [r["completion"]["text"] for r in out] == ["x", "y z"]
    with pytest.raises(Exception, match="script of 1 answers"):
        encoders.completed(rows, "p", encoders.scripted_completer(["x"])).collect()
    assert one(spark, text.clipped(F.lit("abcdef"), 4)) == "abc…" and one(spark, text.clipped(F.lit("abcd"), 4)) == "abcd"


def test_prices_from_a_file(spark, tmp_path):
    path = tmp_path / "prices.json"
    path.write_text('[{"vendor": "added", "model": "m", "input_price": 1.0, "output_price": 2.0}]')
    assert [tuple(r) for r in cost.read_prices(spark, str(path)).collect()] == [("added", "m", 1.0, 2.0)]
