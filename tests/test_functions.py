"""Slugs, colours, view parameters, dense ids."""

from pyspark.sql import functions as F

from pitchside.functions import colour as co
from pitchside.functions.slug import slugify, slugify_py
from pitchside.plans.options import parse_view_params, resolve_sort

SLUGS = {
    "Manchester United": "manchester-united", "Tottenham Hotspur": "tottenham-hotspur",
    "Brighton & Hove Albion": "brighton-and-hove-albion", "Atlético Madrid": "atletico-madrid",
    "Beşiktaş": "besiktas", "Nott'm Forest": "nott-m-forest", "  A.F.C. Bournemouth  ": "a-f-c-bournemouth",
    "!!Arsenal!!": "arsenal", "---Leeds---": "leeds",
}


def test_slugs(spark):
    df = spark.createDataFrame([(k,) for k in SLUGS], "name string")
    got = {r.name: r.slug for r in df.select("name", slugify(F.col("name")).alias("slug")).collect()}
    assert got == SLUGS
    assert all(slugify_py(k) == v for k, v in SLUGS.items())


def _resolve(spark, primary, secondary, ground=co.GROUND_LIGHT):
    df = spark.createDataFrame([(primary, secondary)], "p string, s string")
    r = co.resolve_colours(df, "p", "s", ground, "c").first().c
    return r.hex, r.source, r.contrast


def test_colour_rules(spark):
    assert _resolve(spark, "e20520", "003399")[:2] == ("e20520", "primary")
    assert _resolve(spark, "000000", "ffffff")[:2] == ("000000", "primary")
    assert _resolve(spark, "ffffff", "000000")[:2] == ("000000", "secondary")
    assert _resolve(spark, "99c5ea", "000000")[1] == "adjusted-primary"
    assert _resolve(spark, "fdb913", "32a8dd")[1] == "adjusted-primary"
    assert _resolve(spark, "ffffff", "ffcd00")[1] == "adjusted-secondary"
    assert _resolve(spark, None, None)[1] == "fallback"
    assert _resolve(spark, "junk", None)[1] == "fallback"
    assert _resolve(spark, "#E20520", None)[0] == "e20520"
    assert _resolve(spark, "000000", "ffffff", co.GROUND_DARK)[:2] == ("ffffff", "secondary")
    assert _resolve(spark, "660e36", "333333", co.GROUND_DARK)[1] == "adjusted-primary"
    assert round(_resolve(spark, "000000", None)[2], 2) == 18.77
    for p, s in [("99c5ea", "000000"), ("fdb913", "32a8dd"), ("ffffff", "ffcd00"), ("660e36", "333333")]:
        for ground in (co.GROUND_LIGHT, co.GROUND_DARK):
            assert _resolve(spark, p, s, ground)[2] >= 3
    pair = co.club_colour_pair(spark.createDataFrame([("000000", "ffffff")], "primary_color string, secondary_color string")).first()
    assert (pair.css_light, pair.css_dark) == ("#000000", "#ffffff")


def test_view_params():
    v = parse_view_params({"season": "2024", "venue": "home", "last": "6", "opponents": "top6",
                           "sort": "points", "dir": "desc"})
    assert (v.season, v.venue, v.last_n, v.opponents, v.sort, v.direction) == (2024, "home", 6, "top6", "points", "desc")
    bad = parse_view_params({"season": "abc", "venue": "x", "last": "-3", "opponents": "top3",
                             "sort": "drop table", "dir": "sideways"}, default_season=2025)
    assert (bad.season, bad.venue, bad.last_n, bad.opponents, bad.sort, bad.direction) == \
        (2025, "all", None, "all", "position", "asc")
    assert parse_view_params({"last": "45"}).last_n == 38
    assert parse_view_params({"last": "0"}).last_n is None
    assert parse_view_params({"season": "1999"}, 2030).season == 2030
    assert parse_view_params({"season": ["2001", "2002"]}).season == 2001
    assert resolve_sort(("nonsense", "desc")) == ("position", False)
    assert resolve_sort(None) == ("position", True)


def test_colour_ladder_equals_step_by_step(spark):
    """F5 by halving gives the colour of stepping until the contrast is reached."""
    import random

    from pitchside.functions import colour as co

    def step_by_step(h, ground):
        gl = co._py_lum(ground)
        c = [float(int(h[i:i + 2], 16)) for i in (0, 2, 4)]

        def lum(v):
            s = [x / 255.0 for x in v]
            s = [x / 12.92 if x <= 0.03928 else ((x + 0.055) / 1.055) ** 2.4 for x in s]
            return 0.2126 * s[0] + 0.7152 * s[1] + 0.0722 * s[2]

        for _ in range(40):
            a = lum(c)
            if (max(a, gl) + 0.05) / (min(a, gl) + 0.05) >= 3.0:
                break
            c = [0.95 * x for x in c] if gl > 0.5 else [x + (255.0 - x) * 0.08 for x in c]
        return "".join(f"{max(0, min(255, int(x + 0.5))):02x}" for x in c)

    rnd = random.Random(0)
    colours = [f"{rnd.randrange(1 << 24):06x}" for _ in range(20_000)] + ["ffffff", "000000", "ffff00", "0000ff", "fefefe", "777777"]
    df = co.club_colour_pair(spark.createDataFrame([(c, None) for c in colours], "primary_color string, secondary_color string"))
    seen = set()
    for r in df.select("primary_color", "light", "dark").collect():
        for ground, got in ((co.GROUND_LIGHT, r.light), (co.GROUND_DARK, r.dark)):
            seen.add(got.source)
            assert got.hex == step_by_step(r.primary_color, ground), (r.primary_color, ground)
    assert seen == {"primary", "adjusted-primary"}
