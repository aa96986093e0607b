import base64

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepane.llm.mailtext import own_lines, text_parts
from tidepane.llm.spam import UNKNOWN, SpamLimits, at_cut, calibrated, is_data, message_features, part_features, plain_letters, spam_pages

HEAD = "Message-ID: <1@x.test>\nFrom: A B <a@x.test>\nSubject: lowest price\n"
TALK = "The editor found a cheap mattress near the gate. Could you review the contract and send it before lunch? Thanks for the recipe."
WORDS = ", ".join(["cheap garden shop", "garden deal", "best garden", "garden near me"] * 12)


def mail(body, head=""):
    return f"{HEAD}{head}\n{body}"


def html(body):
    return mail(body, "Content-Type: text/html; charset=utf-8\n")


SPAM = {
    "commas": mail(WORDS),
    "lines": mail("\n".join(["garden shop Belton", "garden deal Norton", "best garden Carlow"] * 15)),
    "with sentences": mail(f"Hello all,\n\n{TALK}\n\n{WORDS}\n\nBest\nA B"),
    "phrases": mail(" ".join(["Why garden shop? Because garden. Our best garden is the cheap garden. garden for all, garden for you, garden deal."] * 8)),
    "hashtags": mail(" ".join(f"#garden_{c} #cheapgarden{c}" for c in "abcdefgh")),
    "tag line": mail("tags: garden, cheap garden, tunnel, garden, boat, garden sale, tunnel near, garden, boat, tunnel"),
    "products": mail("\n".join(f"RL-9231{i} gold chain XL 10{i}.99" for i in range(10))),
    "few links": mail("\n".join(f"https://www.a{i}.test/x?q={i}" for i in range(6)) + "\n\n\nThis message is meant for the addressee only. If it reached you by mistake, delete it and tell the sender. Views in it are the writer's own."),
    "hyphens": mail(" ... ".join(["pas-cher contrat"] * 30)),
    "links": mail("\n".join(f"https://www.a{i}.test/x?q={i}" for i in range(9))),
    "broken links": mail("\n".join(f"hxxps://www[.]a{i}[.]test/x" for i in range(9))),
    "markup links": html("<html><body>" + "".join(f'<li><a href="http://a{i}.test/">garden deal {i}</a>' for i in range(9)) + "</body></html>"),
    "hidden": html(f"<p>{TALK}</p><div style='display:none'>{WORDS} {WORDS}</div>"),
    "base64": mail(base64.b64encode(WORDS.encode()).decode(), "Content-Transfer-Encoding: base64\n"),
    "disguised": mail(" ~ ".join(["g a r d e n   s h o p", "b3st g@rd3n", "gаrdеn dеаl", "g-a-r-d-e-n- -n-e-a-r"] * 8)),
    "multipart": mail(f"--b\nContent-Type: text/plain\n\nsee below\n--b\nContent-Type: text/plain\n\n{WORDS}", 'Content-Type: multipart/mixed; boundary="b"\n'),
    "russian": mail(", ".join(["дешёвый матрас", "матрас скидка", "матрас цена", "заказ матрас"] * 8)),
    "joined japanese": mail("\n".join(["価格 激安 見積書", "価格無料見積書", "最安値見積書送料無料", "見積書割引", "見積書注文", "通販 本物 見積書", "契約書 口コミ", "鍵 割引", "見積書通販", "価格無料見積書", "見積書注文", "見積書割引", "激安 見積書"])),
    "japanese": mail(" ".join(["激安 時計 通販", "時計 送料無料", "最安値 時計"] * 10)),
}

HAM = {
    "talk": mail(f"Hello all,\n\n{TALK} {TALK}\n\nKind regards,\nA B\nA B | Works | a@x.test"),
    "short": mail("Hello all,\n\nyes yes, go go go\n\nBest\nA B\nA B | Works | a@x.test"),
    "talk with links": mail("\n".join(f"{i}. {TALK}\n   https://a{i}.test/x" for i in range(6))),
    "footnotes": mail(f"{TALK} {TALK}\n\n" + "\n".join(f"[{i}] https://a{i}.test/x" for i in range(6))),
    "quoted": mail(f"{TALK}\n\nOn Mon, 1 Jan 2024, C D wrote:\n> " + WORDS.replace(", ", ",\n> ")),
    "quoted without marks": mail(f"{TALK}\n\n-----Original Message-----\nFrom: C D <c@x.test>\nSent: Monday\nSubject: x\n\n{WORDS}"),
    "log": mail(f"{TALK}\n\n" + "\n".join(f"2026-03-21 07:27:0{i % 10} ERROR unit[3099]: ok t=191ms" for i in range(20))),
    "table": mail(f"{TALK}\n\nname;qty;price;note\n" + "\n".join(f"garden;{i};12.5;ok" for i in range(20))),
    "order": mail(f"{TALK}\n\n" + "\n".join(f"{i} x gold chain XL RL-9231{i} 10.99" for i in range(9)) + "\nTotal 99.00"),
    "agenda": mail("Hello,\n\n" + "\n".join(f"- item x{i} (could you review the contract before lunch)" for i in range(9))),
    "build": mail("Build unit #92: passed\n\nBranch: next/x\nCommit: 14ada606ce\n\n" + "\n".join(f"  ok   part{i}::unit (11 ms)" for i in range(9)) + "\n\nDetails are kept for 47 days at https://x.test/7\nYou get this mail because you follow the project."),
    "attachment": mail(f"--b\nContent-Type: text/plain\n\n{TALK}\n--b\nContent-Type: text/plain\nContent-Disposition: attachment\n\n{WORDS}\n--b--", 'Content-Type: multipart/mixed; boundary="b"\n'),
    "misread": mail("お手数ですが、鍵を木曜日にご確認ください。時計の価格は来月決まります。\n\n管理人は木曜日に見積書を確認しました。".encode().decode("latin-1")),
    "misread russian": mail("Пожалуйста, проверьте смету без спешки. Скажите, какая цена на часы? Заказ на шины не готов.".encode().decode("latin-1")),
    "disclaimer": mail(f"{TALK}\n\n\nThis message is meant for the addressee only. If it reached you by mistake, delete it."),
    "signature": mail(f"{TALK}\n-- \n{WORDS}"),
    "empty": "",
    "null": None,
    "headers only": HEAD,
}


SPAM |= {
    "confidential word": mail(f"{WORDS} confidential"),
    "after a rule": mail(f"{TALK}\n\n-------\n{WORDS[:380]}"),
    "before a disclaimer": mail(f"{WORDS[:500]}\n\n____________\nCONFIDENTIAL: the contents may not be passed on. The addressee is asked to delete it."),
    "after a closing": mail("Cheers\n" + "\n".join(["garden shop Belton", "garden deal Norton", "best garden Carlow"] * 15)),
    "in contact lines": mail("\n".join(["cheap garden | best garden shop | a@x.test"] * 12)),
    "one long line with signs": mail("garden deal = " + WORDS),
    "numbers between": mail(" ".join(f"{w} 50%" for w in WORDS.replace(",", "").split())),
    "compounds": mail(" ".join(["<sac> [pas-cher]"] * 20)),
    "leet": mail(", ".join(["n3umát1c0s c0mpr@r", "s3gur0 n3umát1c0s", "b@r@t0 n3umát1c0s"] * 10)),
}


@pytest.fixture(scope="module")
def kinds(spark):
    """Kind of each of the mails above."""
    rows = [*SPAM.items(), *HAM.items(), *((f"{k} crlf", v and v.replace("\n", "\r\n")) for k, v in (SPAM | HAM).items())]
    return {r["name"]: r["kind"] for r in spam_pages(spark.createDataFrame(rows, "name string, text string"), "name").collect()}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name, kinds):
    assert kinds.get(name) and kinds.get(name) == kinds.get(f"{name} crlf")


@pytest.mark.parametrize("name", HAM)
def test_ham(name, kinds):
    assert name not in kinds and f"{name} crlf" not in kinds


def test_data_lines_have_as_many_signs_as_words():
    assert all(map(is_data, ["2026-03-21 07:27:01 ERROR unit[3099]: ok t=191ms", "garden;7;12.5;ok", "def f(x): return x + 1", "3 x gold chain RL-92311 10.99"]))
    assert not any(map(is_data, ["garden deal = cheap garden, best garden", "a ; b ; c ; d", "", "the bill of 1999"]))


def test_thresholds_follow_the_language(spark):
    """Languages differ, spam among the mails is found and the mails are not, and without mails there are the priors."""
    talk = {"en": "The editor number{i} found a cheap mattress{i} near the gate and sent it to us before the lunch of the day{i} with a bill.", "de": "Wir haben die Rechnung Rechnung Rechnung für den Garten{i} mit der Post an das Amt{i} und auch an die Bank{i} geschickt Rechnung."}
    rows = [(i, mail(" ".join(talk[lang].format(i=f"{i}{j}".translate(str.maketrans("0123456789", "abcdefghij"))) for j in range(4)))) for lang in talk for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    t = {r["language"]: r for r in calibrated(at_cut(part_features(df))).collect()}
    assert set(t) == {"en", "de", "fr", "es", "ru", "ja", UNKNOWN} and t["de"]["top"] > t["en"]["top"] + 0.1
    some = spark.createDataFrame([(i, SPAM["with sentences"]) for i in range(20)], "doc_id bigint, text string")
    found = spam_pages(df.unionByName(some.withColumn("doc_id", F.col("doc_id") + 1000)))
    assert {r["doc_id"] for r in found.collect()} == set(range(1000, 1020))
    empty = {r["language"]: r for r in calibrated(at_cut(part_features(df.limit(0)))).collect()}
    assert all(abs(r["top"] - SpamLimits().top) < 1e-9 for r in empty.values())


def test_parts_and_own_lines():
    nested = mail('--o\nContent-Type: multipart/alternative; boundary="i"\n\n--i\nContent-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\ncaf=C3=A9 a=\nb\n--i\nContent-Type: text/html\n\n<p>x</p>\n--i--\n--o\nContent-Type: image/png\n\nAAAA\n--o--', "Content-Type: multipart/mixed; boundary=o\n")
    assert text_parts(nested) == [("plain", "café ab"), ("html", "<p>x</p>")]
    assert own_lines("a\n> b\nOn Monday C wrote:\n> d\ne\n-- \nf") == ["a", "e"]
    assert plain_letters("g a r d e n") == "garden"


@given(st.text(max_size=300))
def test_any_text_is_read(text):
    for m in (text, mail(text, 'Content-Type: multipart/mixed; boundary=""\n'), mail(text, "Content-Transfer-Encoding: base64\nContent-Type: text/html; charset=nope\n")):
        list(message_features(m))


def test_long_texts_end():
    for text in ("a " * 300_000, "https://a.test/ " * 30_000, "<" * 200_000, "=" * 200_000, "[" * 100_000, "x" * 300_000, "a.b-" * 60_000, "g a " * 60_000, "on " * 60_000 + ":"):
        assert list(message_features(mail(text))) and list(message_features(html(text)))


def test_table(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate([*SPAM.values(), *HAM.values()])] + [(0, SPAM["lines"], "x", 1), (None, SPAM["lines"], "x", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, language int")
    got = sorted((r["doc_id"] for r in spam_pages(df).collect()), key=str)
    assert got == sorted([*range(len(SPAM)), 0, None], key=str)
    assert spam_pages(df.limit(0)).count() == 0
