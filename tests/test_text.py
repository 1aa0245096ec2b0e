import random
import unicodedata

from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions import text as tx
from veriframe.functions import urls


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def plain_fold(text):
    lowered = unicodedata.normalize("NFKC", text).lower().translate(str.maketrans(tx.KAZAKH_FROM, tx.KAZAKH_TO))
    bare = "".join(c for c in unicodedata.normalize("NFD", lowered) if not unicodedata.category(c).startswith("M"))
    out = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in bare)
    return " ".join(out.split())


def test_fold_matches_unicode_rules(spark):
    rng = random.Random(5)
    pool = [chr(c) for r in ((0x20, 0x250), (0x370, 0x530), (0x1E00, 0x1F00), (0xFB00, 0xFB07), (0xFF10, 0xFF60),
                             (0x2460, 0x2474), (0x1D400, 0x1D420), (0x300, 0x320), (0x3040, 0x30FF)) for c in range(*r)
            if "Σ" not in unicodedata.normalize("NFKC", chr(c)) and unicodedata.category(chr(c)) != "Cn"]  # final sigma is left to lower()
    texts = ["".join(rng.choice(pool) for _ in range(30)) for _ in range(300)]
    texts += ["Әл-Фараби атындағы Қазақ ұлттық университеті", "École  Polytechnique!", "", "ﬁne ½ ②"]
    assert column(spark, texts, tx.fold_text) == [plain_fold(t) for t in texts]


def test_normalize_and_transliterate(spark):
    assert column(spark, ["Kazakh University", "University", "  КазНУ им. Аль-Фараби  "], tx.normalize_name) == [
        "kazakh", "university", "казну им аль фараби"]

    def slow(text):
        table = dict(zip(tx.LATIN_SINGLE_FROM, tx.LATIN_SINGLE_TO), **tx.LATIN_MULTI)
        pairs = sorted(tx.LATIN_DIGRAPHS, key=lambda d: -len(d[0]))
        out, i = "", 0
        while i < len(text):
            hit = next((d for d in pairs if text.startswith(d[0], i)), None)
            if hit:
                out += hit[1]
                i += len(hit[0])
                continue
            c = text[i]
            out += ("й" if i and text[i - 1] in "aeiou" else "ы") if c == "y" else table.get(c, c)
            i += 1
        return out

    rng = random.Random(3)
    words = ["".join(rng.choice("aeiouyshcztk jxl") for _ in range(12)) for _ in range(400)] + ["nazarbayev", "kyzylorda"]
    assert column(spark, words, tx.lat_to_cyr) == [slow(w) for w in words]
    assert column(spark, ["назарбаев щука"], tx.cyr_to_lat) == ["nazarbaev shchuka"]


def test_cleaning(spark):
    assert column(spark, ["<b>A</b>&amp;lt; &#38;lt; &#x416;&nbsp;&quot;x&quot; &#128512;"], tx.strip_html) == [
        'A &lt; &lt; Ж "x" 😀']
    assert column(spark, ["taken 2014-06-09 09:59", "2014-06", "2014-13-01", "x"], tx.iso_date) == [
        "2014-06-09", "2014-06", None, None]
    masked = column(spark, ["mail a.b@c.org or +7 (701) 555-12-34, see @me_x and a@b"],
                    lambda c: tx.mask_personal_data(c, config.MASK_TOKEN))
    assert masked == [f"mail {config.MASK_TOKEN} or {config.MASK_TOKEN}, see {config.MASK_TOKEN} and a@b"]
    assert column(spark, ["a ( ) b .  c", "x" * 10 + ". " + "y" * 20], lambda c: tx.clip_extract(c, 20)) == [
        "a b. c", "x" * 10 + "."]


def test_sentences(spark):
    text = "Основан в 1934 г. в Алматы. Носит имя К. И. Сатпаева! Big. See e.g. Dr. Who? 3 items"
    assert column(spark, [text], tx.split_sentences) == [[
        "Основан в 1934 г. в Алматы.", "Носит имя К. И. Сатпаева!", "Big.", "See e.g. Dr. Who?", "3 items"]]
    assert column(spark, ["One. Two. Three. Four."], tx.lead_quote) == ["One. Two. Three."]


def test_hints(spark):
    hint = lambda c: tx.category_hint(c, config.CATEGORY_KEYWORDS, config.HINT_ORDER)
    assert column(spark, ["ЧИТАЛЬНЫЙ зал", "Main Building", "Dormitory library", "skyline"], hint) == [
        "library", "campus", "dormitory", None]
    assert column(spark, ["City logo.png", "Logotype", "Карта города", "portrait of x"], tx.is_non_photo) == [
        True, False, True, True]


def test_urls(spark):
    cases = {
        "http://WWW.Site.kz:80/a/photo-1024x768.jpg?utm_source=x&w=640#top": "https://site.kz/a/photo.jpg",
        "https://site.kz/a/photo@2x.png?b=2&a=1": "https://site.kz/a/photo.png?a=1&b=2",
        "https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/F.jpg/640px-F.jpg":
            "https://upload.wikimedia.org/wikipedia/commons/a/ab/F.jpg",
        "https://site.kz": "https://site.kz/", " data:image/png;base64,x ": "data:image/png;base64,x", "nonsense": "nonsense",
        "https://site.kz/x?id=": "https://site.kz/x?id=",
    }
    assert column(spark, list(cases), urls.canonical_url) == list(cases.values())
    assert column(spark, ["kbtu.kz", "www.a.edu.kz", "site.com"], urls.official_hosts) == [
        ["kbtu.kz", "kbtu.edu.kz", "kbtu.ac.kz"], ["a.edu.kz"], ["site.com"]]
    listed = lambda c: urls.host_in_list(c, ["vk.com", "t.me"])
    assert column(spark, ["vk.com", "m.vk.com", "xvk.com", "www.t.me", "tame"], listed) == [True, True, False, True, False]
