import pytest
from hypothesis import given
from hypothesis import strategies as st

from lavra.llm import sentences

CASES = [
    ["já no pátio, a guia chegou desde 22.11.2025.", "o operador saiu."], ["O Dr. Silva recebeu 12,5 kg.", "Depois saiu."], ["Conforme o art. 98, a versão v1.2.3 foi gravada.", "Fim."], ["O enlace caiu... mas voltou.", "Ontem choveu..."], ['Ele escreveu: "Caiu. Vou ligar." e saiu.', "Nada mais."],
    ["Cabos, pilhas, etc. para o setor C.", "Já no pátio, tudo bem."], ["R. C. Fumi checked it.", "Who knows?"], ["See p. 320 (cf. fig. 83).", "The end!"], ["Am 7. Mai: Dr. Gorzu kam an.", "Wer prüft das Los?"], ["Der Verstärker fehlt noch, z. B. wegen Verzug.", "Die Datei ist da."],
    ["El Ing. Bami llegó.", "¿Quién revisa?"], ["М. Иванов проверил комплект, т. е. все 28 деталей.", "На ул. Полевой стоит антенна!"], ["Ο κ. Nalnal υπέγραψε.", "Πόσα κιβώτια έμειναν;", "Λείπουν π.χ. 30 καλώδια."], ["وقّع د. Kiro على الاستلام.", "كم صندوقاً بقي؟"],
    ['संचालक ने कहा, "संपर्क टूट गया। रुकिए।" और चला गया।', "कुल भार 12 किलो है।"], ["डॉ. Linzu ने हस्ताक्षर किए।", "कितने डिब्बे बचे हैं?"], ["(See the note.)", "It works."], ["Restam 90 unidades em Furo Largo.", "904 caixas seguem."],
]


@pytest.mark.parametrize("units", CASES)
def test_spaced_scripts(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in sentences.split(text)] == units


@pytest.mark.parametrize("units", [["在庫は11,600個です。", "担当者は「切れた。待機する。」と記録した。", "どこですか？"], ["请稍等。", "操作员说：“断了。请等。”然后离开。", "（详见附件E。）", "运行正常……但电压低。"], ["56,5 kg ficaram em Salto Curvo.", "Por ordem do Sr. Dansel, caiu."]])
def test_no_spaces(units):
    text = "".join(units)
    assert [text[a:b] for a, b in sentences.split(text)] == units


def test_blocks_lists_and_lines():
    text = "2.1 Saldo por depósito\r\n\r\nA tampa veio\r\nsolta. Fim.\r\n\r\n- Item um. Dois\r\n- Item dois\r\n\r\n1) Verificar.\n2) Outro"
    got = [text[a:b] for a, b in sentences.split(text)]
    assert got == ["2.1 Saldo por depósito", "A tampa veio\r\nsolta.", "Fim.", "- Item um. Dois", "- Item dois", "1) Verificar.", "2) Outro"]


def test_thai():
    text = "เสาอากาศหนัก 262.56 กิโลกรัม ใครเป็นผู้รับผิดชอบ ส่งเลขที่ VE-2023 ให้ฝ่าย"
    assert [text[a:b] for a, b in sentences.split(text)] == ["เสาอากาศหนัก 262.56 กิโลกรัม", "ใครเป็นผู้รับผิดชอบ", "ส่งเลขที่ VE-2023 ให้ฝ่าย"]


@given(st.text(alphabet='aB. \n"?!(«»)1;…。」「ก', max_size=80))
def test_units_cover_all_that_is_not_white(text):
    spans = sentences.split(text)
    at = 0
    for a, b in spans:
        assert a >= at and not text[at:a].strip() and text[a:b] == text[a:b].strip() and b > a
        at = b
    assert not text[at:].strip()


def test_more_than_48_rejected_marks_stay_inside_their_unit():
    units = ["O guia anotou (" + "Caiu a linha. " * 60 + "fim) e saiu.", "Depois choveu."]
    text = " ".join(units)
    assert [text[a:b] for a, b in sentences.split(text)] == units


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \n", 5), (4, "Uma. Duas.", 5), (4, "Uma. Duas.", 5), (5, "Frase longa aqui. " * 20_000, 5)], "doc_id bigint, text string, start_pos int")
    rows = sentences.sentences(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {4: 4, 5: 20_000}
    assert sentences.sentences(df.limit(0)).count() == 0


def _brute(text):
    """The best spans by trying every start for every end."""
    b = len(text)
    marks = sentences.candidates(text, 0, b)
    ends = [0, *(m[0] for m in marks), b]
    last = sentences.CANDIDATE.findall(text, max(0, b - 8), b)
    mark = ["", *(m[2] for m in marks), last[-1].rstrip(sentences.CLOSERS)[-1:] if last else ""]
    gain = [0.0, *(m[1] for m in marks), 0.0]
    broken = [(s, e, sentences.BREAK * max(1, sum(s < x <= e for x in ends))) for s, e in sentences.pairs(text, 0, b)]
    best = [(0.0, None)]
    for j in range(1, len(ends)):
        scored = []
        for i in range(j):
            x, y = ends[i], ends[j]
            long = y - x > sentences.LONG
            word = long or any(sentences._has_word(text, ends[k], ends[k + 1]) for k in range(i, j))
            cut = sum(cost * ((s < x <= e) + (s < y <= e) - 2 * (s < x and y <= e)) for s, e, cost in broken)
            score = best[i][0] + gain[j] - cut + sentences._agree(sentences._kind(text, x, b), mark[j])
            scored.append((score - (1.5 if y - x < 4 else 0) - (0 if word else sentences.WORDLESS) - (sentences.PER_LETTER * (y - x - sentences.LONG) if long else 0), i))
        best.append(max(scored, key=lambda s: s[0]))
    return best[-1][0], ends


def _value(text, spans, ends):
    """What the chosen spans score, by the same sums."""
    b = len(text)
    at = {m[0]: m for m in sentences.candidates(text, 0, b)}
    last = sentences.CANDIDATE.findall(text, max(0, b - 8), b)
    total = 0.0
    for x, y in spans:
        _, gain, mark = at.get(y, (b, 0.0, last[-1].rstrip(sentences.CLOSERS)[-1:] if last else ""))
        long = y - x > sentences.LONG
        inner = [e for e in ends if x <= e <= y]
        word = long or any(sentences._has_word(text, u, v) for u, v in zip(inner, inner[1:]))
        cut = 0.0
        for s, e in sentences.pairs(text, 0, b):
            if (s < x <= e) != (s < y <= e) or (s < x <= e and s < y <= e and not (s < x and y <= e)):
                cut += sentences.BREAK * max(1, sum(s < z <= e for z in ends))
        total += gain - cut + sentences._agree(sentences._kind(text, x, b), mark) - (1.5 if y - x < 4 else 0) - (0 if word else sentences.WORDLESS) - (sentences.PER_LETTER * (y - x - sentences.LONG) if long else 0)
    return total


WORDS = st.sampled_from(["Caiu a linha. ", "o Sr. ", "p. 12 ", '"Eu vou. Eu fico." ', "(veja. aqui) ", "(Um. (Dois. Três.) Quatro. ", "fim) ", "¿Quem veio? ", "Qual deles. ", "J. ", "e. ", "x " * 150, "«Sim. " + "Nada ficou. " * 40 + "Fim.» ", "etc. ", "12. "])


@given(st.lists(WORDS, min_size=1, max_size=12))
def test_the_search_finds_the_best_spans_of_all(parts):
    text = "".join(parts).strip()
    score, ends = _brute(text)
    assert abs(_value(text, sentences.split_paragraph(text, 0, len(text)), ends) - score) < 1e-6


@pytest.mark.parametrize("units", [["j. Linnal checked the diesel generator.", "e. A. Selqua checked the cable since 02.06.2024!", "c. Torfu packed it."], ["m. Kilin a reçu 63 caisses sans réserve."]])
def test_spans_are_judged_whole_where_marks_alone_mislead(units):
    text = " ".join(units)
    alone = [x for x, score, _ in sentences.candidates(text, 0, len(text)) if score > 0]
    assert alone != [len(" ".join(units[: k + 1])) for k in range(len(units) - 1)]
    assert [text[a:b] for a, b in sentences.split(text)] == units


@pytest.mark.parametrize("k", [47, 48, 500, 5000])
def test_any_number_of_rejected_marks(k):
    text = "Ver " + "p. 12 " * k + "do anexo."
    assert sentences.split(text) == [(0, len(text))]
