import hashlib

from pyspark.sql import functions as F

from corpusweave.functions import assets, text, urls

SITE = urls.Site(origin="https://en.wikipedia.org")


def test_link_href(column):
    rows = ["London", "Blue whale", "A/B c", "/dev/null", "100%", "C'est (ça)!", "a+b&c", "Zürich", "~x*"]
    want = ["London", "Blue_whale", "A/B_c", "./" + "/dev/null", "100%25", "C'est_(%C3%A7a)!", "a%2Bb%26c", "Z%C3%BCrich", "~x*"]
    assert column(rows, "t string", text.link_href("t")) == want


def test_relative_href(column):
    rows = [("Mill/Pond/Weir", "a/b.svg"), ("Mill///Pond/Weir", "b"), ("//Mill//Pond", "b"), ("Mill/Pond", "a/b.svg"), ("/Mill", "b"), ("Mill", "a/b.svg"), ("", "b")]
    want = ["../../a/b.svg", "../../b", "../b", "../a/b.svg", "./b", "./a/b.svg", "./b"]
    assert column(rows, "p string, b string", text.relative_href("p", "b")) == want


def test_truncate_words(column):
    # a word holds 240 bytes at most; each word of a title is judged alone
    long, fits = "ngx" * 90, "kl" * 120
    rows = [f"up {long} down", fits + "z", f"{fits} {fits} {long}", "q" * 239 + "é", "q" * 238 + "é", "short words only", ""]
    want = [f"up {long[:240]} down", fits, f"{fits} {fits} {long[:240]}", "q" * 239, "q" * 238 + "é", "short words only", ""]
    assert column(rows, "t string", text.truncate_words("t")) == want


def test_truncate_words_never_splits_a_character(column):
    word = "a" + "😀" * 100
    (got,) = column([word], "t string", text.truncate_words("t"))
    assert got == "a" + "😀" * 59


def test_href_title(column):
    cases = {
        "/wiki/Oak": "Oak", "./Tall_Tree": "Tall Tree", "../../River_Bank": "River Bank", "./Garden#Roses": "Garden", "Meadow": None,
        "./Pond?action=edit&redlink=1": "Pond", "/w/index.php?title=Old_Mill": "Old Mill", "/w/index.php?action=edit&title=New_Mill&redlink=1": "New Mill",
        "/w/index.php?action=edit&redlink=1": None, "https://en.wikipedia.org/wiki/Stone_Bridge": "Stone Bridge", "/wiki/Caf%C3%A9_%C5%BBubr": "Café Żubr",
        "": None, "../Ferry": None,
    }
    assert column(list(cases), "h string", urls.href_title("h", SITE)) == list(cases.values())


def test_geo_href(column):
    # 12 degrees 30 minutes are 12.5 degrees, 36 seconds are a hundredth
    cases = {
        "//geo.example.org/geohack/geohack.php?pagename=Hill&params=12_30_36_N_3_15_0_W_type:hill": "geo:12.51,-3.25",
        "http://geo.example.org/geohack/geohack.php?language=de&params=7.125_N_8.5_E_scale:1": "geo:7.125,8.5",
        "http://geo.example.org/geohack.php?params=1.5;-2.25_type:x": "geo:1.5,-2.25",
        "http://maps.example.org/w/poimap2.php?lat=4.75&lon=6.5&zoom=3": "geo:4.75,6.5",
        "/wiki/Special:Map/5/10.25/-20.5/fr": "geo:10.25,-20.5",
        "http://geo.example.org/geohack.php?pagename=Nowhere": None,
        "http://geo.example.org/geohack.php?params=9_8_7_6_N_5_E": None,
        "http://geo.example.org/geohack.php?params=11_S_22_O": "geo:-11,22",
    }
    assert column(list(cases), "h string", urls.geo_href("h")) == list(cases.values())


def test_absolute_url(column):
    cases = {
        "//google.com": "https://google.com/",
        "/wiki/A": "https://en.wikipedia.org/wiki/A",
        "../x.png": "https://en.wikipedia.org/x.png",
        "./y": "https://en.wikipedia.org/w/y",
        "a/../b?q=../1": "https://en.wikipedia.org/w/b?q=../1",
        "http://a.org": "http://a.org/",
        "http://a.org/x/./y/../z": "http://a.org/x/z",
        "data:image/png;base64,aa": "data:image/png;base64,aa",
        "?q=1": "https://en.wikipedia.org/w/load.php?q=1",
        "../../../up": "https://en.wikipedia.org/up",
    }
    got = column(list(cases), "h string", urls.absolute_url("h", "https://en.wikipedia.org/w/load.php"))
    assert got == list(cases.values())


def stored(folder, name):
    return "_assets_/" + hashlib.md5(folder.encode()).hexdigest() + name


POOL = "https://pool.example.org/site/commons/"
LONG = "A_very_long_name_%28with_signs%29_" + "and_more_" * 12
ASSETS = {
    POOL + "thumb/1/1a/Boat.jpg/320px-Boat.jpg": stored(POOL, "/Boat.jpg"),
    POOL + "1/1a/Boat.jpg": stored(POOL, "/Boat.jpg"),
    POOL + "thumb/2/2b/Wave_form.svg/64px-Wave_form.svg.png": stored(POOL, "/Wave_form.svg.png"),
    POOL + "thumb/2/2b/Wave_form.svg/64px-Wave_form.svg.png?utm_source=a&utm_content=b": stored(POOL, "/Wave_form.svg.png"),
    POOL + f"thumb/3/3c/{LONG}.svg/90px-thumbnail.svg.png": stored(POOL, "/" + LONG.replace("%28", "(").replace("%29", ")") + ".svg.png"),
    "https://game.example.com/images/thumb/Iron_Key.png/40px-Iron_Key.png?1a2b": stored("https://game.example.com/images/", "/Iron_Key.png"),
    "https://game.example.com/images/thumb/4/4d/Gold_Key.png/40px-Gold_Key.png?3c": stored("https://game.example.com/images/", "/Gold_Key.png"),
    "https://rest.example.org/api/media/math/render/svg/0123456789abcdef": stored("https://rest.example.org/api/media/math/render/svg/", "/0123456789abcdef.svg"),
    "https://static.example.net/farm/images/5/5e/Red_%28barn%29.png/revision/latest?cb=2024": stored("https://static.example.net/farm/images/", "/Red_(barn).png"),
    POOL + "6/6f/Sk%C3%B3g.ogg": stored(POOL, "/Sk%C3%B3g.ogg"),
    "https://bad.example.org/a%ZZ.png": None,
}


def test_asset_path(column):
    assert column(list(ASSETS), "u string", assets.asset_path("u", escape=True)) == list(ASSETS.values())


def test_asset_path_unescaped(column):
    assert column([POOL + "6/6f/Sk%C3%B3g.ogg"], "u string", assets.asset_path("u")) == [stored(POOL, "/Skóg.ogg")]


def test_size_from_url(column):
    cases = {
        POOL + "thumb/7/70/500px-tile.png/75px-500px-tile.png": (75, None), POOL + "thumb/8/81/tile.jpg/75px-tile.jpg": (75, None),
        POOL + "tile.webp/310px-tile.webp": (310, None), POOL + "tile-3x.png": (None, 3.0), POOL + "7x-tile-2.5x.png": (None, 2.5), POOL + "tile.png": (None, None),
    }
    got = column(list(cases), "u string", F.struct(assets.url_width("u"), assets.url_multiplier("u")))
    assert [tuple(g) for g in got] == list(cases.values())
