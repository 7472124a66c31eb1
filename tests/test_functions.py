from datetime import date

import pytest
from pyspark.sql import functions as F

from siftline.functions import dates as D, parsers as P, places as G, text as T


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_clean(spark):
    assert values(spark, ["  a \t b\r\n\n\n\nc ", "", " \n ", None], T.clean) == ["a b \n\nc", None, None, None]


def test_tokens(spark):
    got = values(spark, ["C++ and C#, node.js; CI/CD .NET a", "Käyttöliittymä x 42", None], T.tokens)
    assert got == [["cpp", "and", "csharp", "nodejs", "cicd", "dotnet"], ["käyttöliittymä", "42"], []]


@pytest.mark.parametrize("name,key", [("Academic Work Finland Oy", "academic work"), ("Oy Hartwall Ab", "hartwall"), ("Oy", "oy"), ("Maersk A/S", "maersk"), ("Sp. z o.o.", "sp z o o"), ("Café Group", "cafe"), (None, ""), ("Group Holding Oy", "group")])
def test_company_key(spark, name, key):
    assert values(spark, [name], T.company_key) == [key]


@pytest.mark.parametrize("text,tags", [
    ("React and Node.js", ["web"]), ("Vitamin C and plan C", []), ("C, Python and Rust", ["c_cpp", "python", "rust"]), ("embedded C firmware", ["c_cpp", "embedded"]), ("C-level manager", []), ("we trust you", []), ("iOS and Swift", ["mobile"]),
    ("go to market", []), ("Go developer", ["go"]), (".NET and C#", ["dotnet"]), ("QA testers", ["qa"]), ("ä.net", [])])
def test_stacks(spark, text, tags):
    assert values(spark, [text], T.stack_tags) == [tags]


@pytest.mark.parametrize("text,day", [
    ("Application deadline: 13 September 2026", "2026-09-13"), ("apply via our portal by 26/10/2026", "2026-10-26"), ("Bewerbungsfrist: 1. März", "2027-03-01"), ("closing date September 13th", "2026-09-13"), ("deadline-driven", None),
    ("deadline 31.2.2026 or 1.3.2027", "2027-03-01"), ("deadline soon. Founded 2026-10-10", None), ("hakuaika päättyy 13. syyskuuta", "2026-09-13"), ("deadline 2019-01-01", None), (None, None), ("deadline 20 August", "2026-08-20")])
def test_deadline(spark, text, day):
    assert values(spark, [text], lambda x: D.find_deadline(x, date(2026, 9, 1)).cast("string")) == [day]


@pytest.mark.parametrize("text,code", [
    ("Helsinki, Finland", "FI"), ("Birmingham, AL", "US"), ("Amsterdam, NH, NL", "NL"), ("Milano, MI", "IT"), ("Berlin, DEU", "DE"), ("Somewhere", None), ("Atlanta, Georgia, USA", "US"), ("UK", "GB"), ("Utrecht, NL, 3584 AB", "NL"), ("Toronto, ON", "CA"), ("X | Tallinn", "EE"), (None, None),
    ("Rome, GA", "IT"), ("Dublin, CA", "IE"), ("Bristol, CT", "US"), ("Nicosia, CY", "CY"), ("Valletta, MLT", "MT"), ("Beijing", "CN"), ("Seoul, South Korea", "KR"), ("O'Fallon, Missouri", "US"), ("can we", None), ("Cambridge, MA", "US"), ("Paris, Texas", "US"), ("São Paulo", "BR"), ("Bad Homburg", "DE"), ("", None), ("Mexico City | Austin", "MX")])
def test_country(spark, text, code):
    assert values(spark, [text], G.guess_country) == [code]


@pytest.mark.parametrize("text,years", [("Minimum 5 years of engineering experience, 1 year of experience with X", 5), ("1-3 years experience", 1), ("founded 10 years ago", None), ("25 years of experience", None), (None, None), ("experience" + " " * 70 + "4 years", 4), ("experience" + " " * 90 + "4 years", None), ("7 years old. " + "x" * 90 + " 2 years of working", 2), ("3 years" + "x" * 200 + "5 years" + " " * 60 + "background", 5)])
def test_years(spark, text, years):
    assert values(spark, [text], D.years_required) == [years]


@pytest.mark.parametrize("text,region", [("US only", "us_only"), ("anywhere in Europe", "europe"), ("Worldwide", "worldwide"), ("Israel only", "country_only:IL"), ("", "unknown"), ("home", "unknown"), ("Nowhere only", "unknown")])
def test_region(spark, text, region):
    assert values(spark, [text], G.remote_region) == [region]


def test_html_references_without_semicolons(spark):
    """Read as browsers do, or left as they are where only closed ones count."""
    html = "<h1>a&amp</h1>b &lt; &#65; &#x42; &nosuch; &ampx; &copy2 & c<script>&amp</script>"
    assert P.text_of_html(html) == "a&\nb < A B &nosuch; &x; ©2 & c"
    assert P.text_of_html(html, closed=True) == "a&amp\nb < A B &nosuch; &ampx; &copy2 & c"
    assert values(spark, [html, None], P.strip_html_closed) == [P.text_of_html(html, closed=True), None]


def test_html(spark):
    assert P.text_of_html("<p>a <b>b</b></p><script>x</script><ul><li>c<li>d</ul>&amp;") == "a b\nc\nd\n&"
    got = values(spark, ["<p>...</p>", "a{color:red} b{margin:0} " * 20, "<p>" + "real words " * 9 + "</p>", " plain words of a body that are long enough to be read ", None], P.clean_description)
    assert got == [None, None, ("real words " * 9).strip(), "plain words of a body that are long enough to be read", None]


@pytest.mark.parametrize("value,iso", [("2024-01-02T03:04:05Z", "2024-01-02T03:04:05+00:00"), ("1704164645", "2024-01-02T03:04:05+00:00"), ("1704164645000", "2024-01-02T03:04:05+00:00"), ("Tue, 02 Jan 2024 03:04:05 +0000", "2024-01-02T03:04:05+00:00"), ("2.1.2024", "2024-01-02T00:00:00+00:00"), ("?", None), (None, None),
    ("2 Jan 2024 05:04:05 +0200", "2024-01-02T03:04:05+00:00"), ("Tue, 2 Jan 2024 03:04:05 GMT", "2024-01-02T03:04:05+00:00"), ("2024-01-02", "2024-01-02T00:00:00+00:00"), ("2 de janeiro de 2024", "2024-01-02T00:00:00+00:00"), ("02-01-2024", "2024-01-02T00:00:00+00:00")])
def test_moment(spark, value, iso):
    assert values(spark, [value], lambda x: F.date_format(D.parse_date(x), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")) == [iso]


@pytest.mark.parametrize("text,day", [("3 days ago", "2026-08-29"), ("Yesterday", "2026-08-31"), ("há 2 semanas", "2026-08-18"), ("30+ days ago", "2026-08-02"), ("hoje", "2026-09-01"), ("5 hours ago", "2026-09-01"), ("a month ago", "2026-08-02"), ("soon", None), (None, None)])
def test_relative_day(spark, text, day):
    assert values(spark, [text], lambda x: D.relative_day(x, date(2026, 9, 1)).cast("string")) == [day]


def test_evergreen(spark):
    df = spark.createDataFrame([("Register  your INTEREST", "talent pool"), ("x", "our Talent\nPool"), ("x", None)], "a string, b string")
    assert [r[0] for r in df.select(T.evergreen(F.col("a"), F.col("b"))).collect()] == ["register your interest", "talent pool", None]


def test_names(spark):
    assert values(spark, [" Ärt & Co/2_x ", "..a..", None], T.safe_name) == ["art-co-2-x", "a", ""]
    assert values(spark, ["ACME Corp. GmbH", "Nokia Oyj", "IBM", "Maersk A/S"], T.short_company) == ["Acme", "Nokia", "IBM", "Maersk"]
    assert values(spark, ["gap: x", "other", "what: y"], lambda c: T.note_kind(c, ["gap"])) == ["gap", "uncategorised", "uncategorised"]
    assert spark.range(1).select(T.in_vocabulary(F.array(F.lit("b"), F.lit("z"), F.lit("a"), F.lit("b")), ["a", "b", "c"])).first()[0] == ["a", "b"]


def _fits(pattern, r):
    """A text that a pattern fits, by chance."""
    from re import _constants as C, _parser

    def one(part):
        out = ""
        for op, x in part:
            if op is C.LITERAL:
                out += chr(x)
            elif op is C.BRANCH:
                out += one(r.choice(x[1]))
            elif op is C.SUBPATTERN:
                out += one(x[3])
            elif op is C.MAX_REPEAT:
                out += "".join(one(x[2]) for _ in range(r.randint(x[0], min(x[1], x[0] + 2))))
            elif op is C.IN:
                kind, value = r.choice(x)
                out += {C.LITERAL: lambda: chr(value), C.RANGE: lambda: chr(r.randint(*value)), C.CATEGORY: lambda: " " if value is C.CATEGORY_SPACE else "y"}[kind]()
            else:
                assert op in (C.AT, C.ASSERT, C.ASSERT_NOT), op
        return out

    return one(_parser.parse(pattern))


def test_stack_pieces_lose_no_tag(spark):
    """What a pattern fits holds one of its pieces: tags are those of the patterns alone, also with odd capitals."""
    import random

    r = random.Random(3)
    texts = [w for p in T.V.STACKS.values() for w in (_fits(p, r) for _ in range(120)) if w]
    texts += [t.upper() for t in texts] + [t.replace("s", "\u017f").replace("k", "\u212a").replace("i", "\u0130") for t in texts] + ["", None, "nothing of the kind", "go / c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(F.concat(F.lit("x "), "t", F.lit(" y")).alias("t"))
    plain = F.filter(F.array(*[F.when(T.found(F.col("t"), "(?iuU)" + p), tag) for tag, p in sorted(T.V.STACKS.items())]), lambda x: x.isNotNull())
    rows = df.select(T.stack_tags(F.col("t")).alias("got"), plain.alias("want"), T.folds_oddly(F.col("t")).alias("odd")).collect()
    assert all(x.got == x.want for x in rows) and {t for x in rows for t in x.want} == set(T.V.STACKS) and any(x.odd and x.want for x in rows)


def test_plain_searches_pass_over_no_cue_or_language(spark):
    """Texts that are passed over quickly hold no deadline phrase and no name of a language, in whatever case."""
    from siftline.functions import dictionary as W

    names = [n for x in T.V.LANGUAGE_NAMES.values() for n in x]
    texts = [f"Hello. {x} 2024-05-02 is required" for x in [*names, *T.V.DEADLINE_CUES, "apply soon or by"]]
    odd = str.maketrans("ski\u0441", "\u017f\u212a\u0131\u1c83")
    texts = [y for x in texts for y in (x, x.upper(), x.translate(odd))] + ["nothing", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    cue = F.col("t").rlike("(?iu)" + D.deadline_cue())
    rows = df.select(cue.alias("cue"), D._may_have_cue(F.col("t")).alias("may")).collect()
    assert sum(x.cue for x in rows) >= 3 * len(T.V.DEADLINE_CUES) and all(x.may for x in rows if x.cue) and not all(x.may for x in rows)
    low = F.lower("t")
    rows = df.select(low.rlike(W.mentions(names)).alias("named"), (low.rlike(W.mentions(names, W.PLAIN_START)) | T.folds_oddly(low)).alias("may")).collect()
    assert sum(x.named for x in rows) >= 2 * len(names) and all(x.may for x in rows if x.named) and not all(x.may for x in rows)
