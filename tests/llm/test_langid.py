import numpy as np
import pyarrow as pa

from lodestone.llm import langid, queries

from .conftest import SMALL

COUNTRY = {"en": "com", "de": "de", "fr": "fr"}
SENTENCES = {"en": "the house is on the hill and we walk there with the dog every day of the week",
             "de": "das haus steht auf dem berg und wir gehen jeden tag mit dem hund dorthin spazieren",
             "fr": "la maison est sur la colline et nous y allons tous les jours avec le chien"}


def page(lang, text, declared=True):
    return f"<html{' lang=' + lang if declared else ''}><script>the the the</script><body><p>{text}</p></body></html>"


def frames(spark, pages):
    docs = spark.createDataFrame([(k, " ".join(s.split()[j % 5:]), lang) for k, (lang, s) in enumerate(SENTENCES.items()) for j in range(20)],
                                 "doc_id long, text string, lang string")
    return spark.createDataFrame(pages, "page_id long, url string, html string, score int"), docs


def test_every_page_of_the_table(spark):
    rows = queries.op9_language_id(spark, SMALL).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(urls) and np.mean([f"/{r.lang}/" in urls[r.page_id] for r in rows]) > 0.97


def test_evidence_beyond_the_text_decides_short_pages(spark):
    pages = [(k * 100 + i, f"https://site{i % 3}.{COUNTRY[lang]}/{i}", page(lang, s), 0) for k, (lang, s) in enumerate(SENTENCES.items()) for i in range(12)]
    pages += [(900, "https://site1.fr/x", page("fr", "ok", False), 0), (901, None, page("de", "12"), 0), (902, "https://site2.de/q", None, 0),
              (903, "https://new.fr/x", "", 0), (903, "https://new.fr/x", "", 0)]
    frame, docs = frames(spark, pages)
    got = [(r.page_id, r.lang, r.probability) for r in langid.languages(frame, docs).collect()]
    assert len(got) == len(pages) and all(0 < p <= 1 for _, _, p in got)
    by_id = {i: lang for i, lang, _ in got}
    assert all(by_id[k * 100 + i] == lang for k, lang in enumerate(SENTENCES) for i in range(12))
    assert (by_id[900], by_id[901], by_id[902], by_id[903]) == ("fr", "de", "de", "fr")


def test_trigrams_against_a_loop():
    texts = ["Über  die Straße!", "", None, "ab", "a b"]
    row, cell = langid.trigrams(pa.array(texts))
    counts = np.bincount(row, minlength=len(texts)).tolist()
    def plain(t):
        kept, before = [], False
        for b in (t or "").lower().encode():
            letter = 97 <= b <= 122 or b >= 128
            if letter or before:
                kept.append(b)
            before = letter
        return max(len(kept) - 2, 0)
    assert counts == [plain(t) for t in texts] and cell.max() < langid.CELLS


def test_corner_cases(spark):
    pages, docs = frames(spark, [(None, None, None, 1), (1, "not a url", "<", 2), (2, "http://", "x" * 200000, 3)])
    assert langid.languages(pages, docs).count() == 3
    assert langid.languages(pages.limit(0), docs).count() == 0
    none = langid.languages(pages, docs.limit(0)).collect()
    assert len(none) == 3 and {r.lang for r in none} == {None}
