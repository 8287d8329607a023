import pytest

from roadweave.llm import pii

#: Marked by hand: [type|text].
MARKED = [
    "Write to [email|anna.rossi+x@posta.example] or [email|rossi (at) mail.test], not edges@v012.gpkg nor release@2022.",
    "operatore=[email|ufficio.rossi[at]example dot com];esito=OK <[email|A-B@GEO-LAB.EXAMPLE]> [email|rossi@ posta.example] grazie",
    "mail [email|r.bianchi[at]mail[dot]test], then [email|rossi31 AT posta.example] before 7.8.2024.",
    "tel. [phone|+39 (0440) 999-818], [phone|0039 305 37 01 934] or [phone|(01632) 960 279] after 17:00, [phone|+43 (0) 4999 65647-0].",
    "usare [phone|300/2094942] (chiede [name|Rossi, Luca]) ([phone|0430 902606]). Serial numbers 0440/378 and 118/259; 04/07/2024; 3452/2022.",
    "[phone|09/139-6993] [phone|+386 9 299 2950] [phone|302.897.4246] [phone|+393076562792] km 69+427, 45.93123 13.12345",
    "patente [id_number|U1X761711B], C.F. [id_number|RSSMRA80A01H501U]; [id_number|tft vmv 69m48 y767o] ID [id_number|YY 51487 GL]. EMŠO: [id_number|0710971506256] of 23125 is",
    "residente in [address|via San Vito n. 25], Udine; [address|P.zza del Guado, 42] entro il 27.11.2024; lungo via Olmi il senso unico",
    "kept at [address|No. 7 Hollow St.]. The gate of [address|118, Low Meadow Road], ask for [name|Joan Colin Smith].",
    "wohnhaft [address|Lindenstr. 108a]. [name|Jürgen Huber], [address|Alte Postgasse 144/2]; naslov [address|ulica Stara pot 117 a].",
    "Abito in [address|borgo della Ghiaia\n111] e il rumore; [address|viale Olmi 79 bis], chiedere di [name|FABIO VERDI].",
    "L'ing. [name|Verdi] e la dott.ssa [name|Bianchi]; Signora [name|Neri-Bruni], il metodo Tarvelli; Dr  [name|Ashby] doubts",
    "presenti [name|Caterina Bianchi], [name|Tullio Verdi-Ronda] e il geom. [name|Neri]. Firma: [name|giulia neri], [name|G. Bianchi Verdi].",
    "Signed [name|Alice Maeve Brown], ID 12. Best regards,\n[name|Peter Brown]\n[phone|01632 960867]\nOnly 302 rows. [address|v.le Olmi 6/A]. La tavola",
]


def parse(marked):
    text, spans, i = "", [], 0
    import re

    for m in re.finditer(r"\[(email|phone|id_number|address|name)\|((?:[^\[\]]|\[[^\]|]*\])*)\]", marked):
        text += marked[i : m.start()]
        spans.append((len(text), len(text) + len(m.group(2)), m.group(1)))
        text += m.group(2)
        i = m.end()
    return text + marked[i:], spans


@pytest.mark.parametrize("marked", MARKED)
def test_marked(marked):
    text, want = parse(marked)
    got = pii.find(text)
    assert [(text[i:j], k) for i, j, k in got] == [(text[i:j], k) for i, j, k in sorted(want)]
    assert got == sorted(want)


def test_redaction_keeps_the_rest():
    text, spans = parse(MARKED[8])
    assert pii.redact_text(text) == "kept at <ADDRESS>. The gate of <ADDRESS>, ask for <NAME>."
    assert pii.redact_text(None) is None and pii.redact_text("") == "" and pii.redact_text("nothing here") == "nothing here"


def test_long_and_odd():
    assert pii.find("x" * 1_000_000) == []
    assert pii.find("0" * 200_000) == []
    assert pii.find("@" * 50_000) == []
    assert pii.find("A. " * 30_000) == []
    assert [k for *_, k in pii.find("İİ anna@mail.test " * 2000)] == ["email"] * 2000
    assert pii.find("via " * 20_000) == []


def test_operator(spark):
    df = spark.createDataFrame([(1, "mail a.b@mail.test", 5), (1, "mail a.b@mail.test", 5), (2, None, 5), (3, "", 5)], "doc long, text string, start_pos int")
    got = pii.find_personal(df, "doc", "text").collect()
    assert [tuple(r) for r in got] == [(1, 5, 18, "email")] * 2
    assert pii.find_personal(df.limit(0), "doc", "text").count() == 0
    assert [r["text"] for r in pii.redact(df, "text").orderBy("doc").collect()] == ["mail <EMAIL>", "mail <EMAIL>", None, ""]


UNLISTED = [
    "Ho parlato con [name|Renato Bianchi] ieri; chiedere di [name|Sergio Tolmezzi], tel. [phone|+34 612 345 678].",
    "[name|Kevin Murphy] called [phone|+1 415 555 2671] and [phone|+48 22 123 45 67], not 0012345678 nor +300 vehicles.",
    "Dear [name|Jennifer Lakeham], the Brown building in New Road stays.\nKind regards,\n[name|Olumide Okafor]",
    "Ansprechpartner: [name|Lukas Obermeier], [name|Ahmed Hassan] und [name|Svetlana Orlova]",
    "Lep pozdrav,\n[name|Vesna Dolinar]",
    "Firma: [name|Tolmezzi, Renzo]\nChi arriva da Lusvizzano Nuova deve svoltare in Via Rossi.",
    "residente in [address|via Roma 12]",
    "wohnhaft [address|Lindenstr. 108a]",
    "naslov [address|ulica Stara pot 117]",
    "he lives at [address|7 Hollow St]",
    "[name|Beatrice Rossi]",
]


@pytest.mark.parametrize("marked", UNLISTED)
def test_names_and_numbers_no_list_has(marked):
    text, want = parse(marked)
    assert pii.find(text) == sorted(want)
