"""Problem 5: template residue, filler, error pages and script notices in place of or amid real content.

Every field is cut into segments at its marks. Detectors of two strengths look at folded text in which misspelt cue words are
put right: unfilled markers, literal non-values, keyboard runs, status codes and exception names are strong and flag a field by
themselves. All else is weak: a segment, or a run of words in it, most of whose content words are cues of error messages,
script notices, filling instructions or filler, and a few forms of sentences. A weak segment flags its field only together with the
evidence of record and host: it must mismatch the record, sharing no term with its address slug, address and title, and
must say little, or be repeated within its host (source type). A segment that reports on something, as descriptions of
a source do, is no residue whatever it speaks of.

Defined results: null and blank fields are never flagged; repeated rows of a record are judged once for each text and the
record is flagged if any is; texts of any length are searched whole; a field of non-values only is flagged however long.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import fold, words
from lavra.session import materialize

FIELDS = ("description", "business_role", "when_to_use", "embedding_hint")
#: A weak segment says little with so many content words, and is repeated if so many records of its host hold it.
LOW_INFORMATION, DUPLICATED = 8, 3

#: What error messages, script notices, filling instructions and filler are made of.
CUES = {
    "error": "erro error falha fail failed failure http status codigo gateway timeout readtimeout servidor server indisponivel unavailable forbidden denied negado proibido unauthorized expirou expirado expirada expired caiu encerrada sessao session "
    "login token acesso access pagina page view visao recurso resource endereco encontrado encontrada localizada found missing existe carregar carregado carregada load loading abrir open opened render rendered exibir display tente tentar retry again "
    "novamente aguarde espere wait requisicoes requests chamadas limite many bad internal interna interno procura procurada solicitada solicitado pedido requested removido removida movida movido moved volte inicio oops ops wrong went deu errado conexao connection "
    "refused reset recusada unable cannot could service valido valida invalido portal site verificando checking inatividade conteudo content momento moment minuto upstream host fora login ler fonte please reload recarregue voce sumiu reach exception typeerror keyerror valueerror nullpointerexception operationalerror",
    "script": "javascript js script scripts scripting navegador browser cookies habilite habilitar habilitado habilitados ative ativar ativo ligue permita permitir libere autorize enable enabled disabled activate allow turn requires required require "
    "precisa precisam needs need needed noscript bloqueou bloqueia bloqueado desativou desativado aceita suporta executa execucao execute client app continue continuar without work uso use loja antes seguir",
    "fill": "descreva descrever preencha preencher preenchido inserir insira informe informar digite digitar completar complete escreva escrever explique resuma detalhe indique coloque cole anote texto campo resumo descricao titulo nota secao trecho "
    "frase palavras aqui depois definir definida provisorio provisoria exemplo pendente elaboracao construcao ver revisar tarde sem ainda placeholder principais previsto suas tabela contem papel setor responsavel entre vinte quarenta quando usar usam espaco escrito escrita consultar",
    "filler": "lorem ipsum dolor amet consectetur adipiscing elit sed sit eiusmod tempor incididunt labore magna aliqua teste test foo bar baz abc xyz bla blah undefined null fulano tal sicrano qwerty asdfgh zxcvbn",
}
#: Cues that real content uses all the time; they count only beside others.
COMMON = frozenset("tabela setor quando usar uso papel fonte codigo entre pedido ler ver recurso campo descricao texto nota titulo visao precisa indique existe principais previsto ativo interno internal host use view status tal consultar".split())
CUE = frozenset(w for group in CUES.values() for w in group.split())
#: Words by which a description reports on something.
REPORTS = frozenset(
    "conta contam lista listam mostra mostram registra registram traz trazem indica indicam guarda guardam cita citam reune reunem exige exigem apresenta apresentam resume resumem detalha detalham consolida consolidam acompanha acompanham "
    "controla controlam preenche preenchem usa usam cabe ocorre serve servem le leem lists counts shows records gives keeps tells holds".split()
)
LINKS = frozenset("a o as os um uma de do da dos das e em no na nos nas ao aos para por com que se the of to and in on is are be this that your our for you we it at an este esta esse essa seu sua ser ter mais ja outra outro vez right now here nao not will does".split())
#: Cue words that may be misspelt, by their first two letters.
_KNOWN = CUE | REPORTS | LINKS | {"principal", "pedidos", "carregador", "carregadores"}
_LONG: dict[str, list[str]] = {}
for _k in sorted(CUE):
    if len(_k) >= 5:
        for _ch in dict.fromkeys(_k[:2]):
            _LONG.setdefault(_ch, []).append(_k)

ASK = r"(?:descreva|informe|digite|insira|escreva|preencha|explique|cole|indique|coloque|resuma|detalhe|anote|complete)"
ACT = rf"(?:{ASK}|inserir|preencher|completar|descrever|explicar|definir|escrever)"
LOREM = "lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqua|sit"
DUMMY = r"(?:teste|test|texto|text|foo|bar|baz|xyz|abc|bla|blah|exemplo|example|palavra|word|null|none|xpto)"
CODE = r"[45]\d\d"

STRONG = [
    # markers that are not filled in
    r"\[\[[^\[\]]{1,60}\]\]", r"\[(?=[^\[\]]*[a-z]{2})[a-z_][a-z0-9_ \-]{1,40}\]", r"\{\{[^{}]{0,60}\}\}", r"\$\{[^{}]{1,60}\}", r"\{\d+\}", r"\{\s*[a-z_][a-z_ ]{2,40}\}",
    r"<<[^<>]{1,60}>>", r"<[a-z_][a-z0-9_ \-]{2,40}>", r"%%[^%]{1,60}%%", r"__+[a-z][^_]*(?:_[^_]+)*__+", r"#[a-z_][a-z0-9_ \-]{2,40}#", r"@@[a-z_]+@@", r"«\s*" + ACT + r"\b[^»]*»",
    r"(?:^|\s):[a-z_]{4,}\b", r"%[sd](?![a-z0-9])", r"_{3,}", r"\.{4,}", r"(?<![a-z])([a-z])\1{3,}(?![a-z])", r"\btbd\b", r"\bfixme\b", r"\btodo\s*:",
    # filler
    rf"\b(?:{LOREM})\b(?:\W+\b(?:{LOREM})\b)+", rf"\b({DUMMY})\b(?:\W+\1\b)+",
    # status codes and exceptions shown instead of content
    rf"\b(?:http|erro|error|status|codigo)\s*[:#]?\s*#?\s*{CODE}\b(?! em\b| e\b|, \d)",
    rf"(?:^|[\s:#])#?{CODE}\s*[:/,.\-–—]?\s*(?:not found|bad gateway|forbidden|internal|pagina nao|service unavailable|gateway|acesso negado|too many|unauthorized|access denied|falha|nao encontrad)",
    r"\b[a-z]{2,}error\b", r"\b[a-z]+exception\b", r"\b(?:read|connect|socket|gateway) ?timeout\b", r"\btraceback\b", r"\bnoscript\b",
]
#: Forms of whole segments that need the evidence of record and host.
WEAK = [
    rf"(?:^|[\W])(?:por )?ex\.?\s*:?\s*(?:{ASK}|consultar|usar|tabela|fonte|lista)\b", rf"^\W*{ASK}\b", rf"\b{ACT}\b[^.!?]{{0,60}}\b(?:aqui|depois)\b", rf"\ba {ACT}\b", r"\bem (?:elaboracao|construcao)\b", r"\b(?:com suas palavras|(?:em|numa) uma frase|vai aqui|aqui vai)\b", rf"\b{ASK} (?:entre|neste|nesta|o|a|os|as|com|em)\b",
    r"\b(?:resumo|campo|texto|descricao|conteudo|nota|trecho|secao) (?:provisori[oa]|ainda|em elaboracao)\b", r"\b(?:resumo|campo|texto|descricao|conteudo|nota) pendente(?=\W*$| pelo setor)",
    r"\bnome_d[aeo]_\w+", r"\b[a-z]+_[xyz]\b", r"\b(?:fulano|sicrano|beltrano) de tal\b", r"\babc 123\b", r"\baaa bbb\b", rf"^\W*{DUMMY}\W*$", r"\btimeout (?:ao|em|while|after|error)\b", r"\bops!", r"\b(?:cannot|could not|unable to|failed to) [a-z]+ (?:your|the|this|our|requested)\b", r"\b(?:recurso|pagina|endereco|conteudo) (?:pedid|solicitad|procurad)[oa]\b",
    r"\b(?:javascript|js|scripts?|scripting|cookies) (?:is|are|must be) (?:required|needed|necessary|disabled|enabled)\b", r"\berro (?:ao|de|na|no) (?:conexao|conectar|carregar|abrir|ler|leitura|acesso)\b", r"\b(?:sessao|token|acesso|session)\b[^.!?]{0,14}\b(?:expirou|caiu|valid[oa]|encerrad[oa]|expired)\b",
]
#: Whole fields that say nothing, as words without the marks between them.
NON_VALUES = r"(?:n [adi]|na|nd|null|none|nan|nil|undefined|void|vazio|nenhum[oa]?|sem (?:informacao|dados|texto|conteudo)|nao (?:informad[oa]|disponivel|se aplica|ha|consta)|desconhecid[oa]|pendente|todo|manual|x+|z+|0+|1234?5?6?|s n|s d|tbc|tba|teste|test|texto|exemplo|foo|bar|xyz|abc)"
WHOLE = rf"(?:{NON_VALUES}(?: |$))+$"
LITERAL = r"(?<![\w\-/])(?:null|none|undefined|nan|n/a)(?![\w\-/])"

#: Marks without which a pattern cannot match, by how the pattern begins: a look for them is cheaper than a search.
_NEEDED = {r"\[": "[", r"\{": "{", r"\$": "${", "<": "<", "%%": "%%", "%[": "%", "__": "__", "_{": "___", "#": "#", "@@": "@@", "«": "«", r"(?:^|\s):": ":", r"\.{4": "...."}
_STRONG = [(next((mark for start, mark in _NEEDED.items() if p.startswith(start)), ""), re.compile(p)) for p in STRONG]
_WEAK = [re.compile(p) for p in WEAK]
_WHOLE = re.compile(WHOLE)
_LITERAL = re.compile(LITERAL)
_TODO = re.compile(r"(?<![A-Za-z])TODO(?![A-Za-z])|(?<![A-Za-z])N/A(?![A-Za-z])")
_TOKEN = re.compile(r"[a-z]{4,}")
_MARKS = re.compile(r"[\W_]+")
_SEGMENT = re.compile(r"(?<=[.!?;])\s+|\n+")
_LETTERS = re.compile(r"[a-z]+")
_KEYS = {ch: (row, at) for row, keys in enumerate(("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")) for at, ch in enumerate(keys)}
_TYPED = re.compile(r"[a-z]+|\d+")


def _run(token: str) -> bool:
    """Whether a token runs along one row of the keyboard, either way, leaving out single keys at most."""
    at = [_KEYS.get(ch, (9, 0)) for ch in token]
    steps = [y[1] - x[1] if x[0] == y[0] < 9 else 9 for x, y in zip(at, at[1:])]
    return len(token) > 2 and (all(0 < d <= 2 for d in steps) or all(-2 <= d < 0 for d in steps))


def _mashed(folded: str) -> bool:
    """Whether a longer word is a keyboard run, or two tokens beside each other are, or the only one is."""
    tokens = _TYPED.findall(folded)
    if any(len(t) > 5 and t.isalpha() and max(map(t.count, set(t))) >= 0.75 * len(t) for t in tokens):
        return True  # one letter over and over
    run = [_run(t) for t in tokens]
    return any(r and t.isalpha() and (len(t) > 3 or k and run[k - 1] or run[k + 1 : k + 2] == [True] or len(tokens) == 1) for k, (t, r) in enumerate(zip(tokens, run)))


def cued(tokens: list[str]) -> tuple[int, int]:
    """(start, end) of the words that are mostly cues, (0, 0) if none are: the whole segment, or a run of four content words."""
    at = [k for k, t in enumerate(tokens) if t not in LINKS and len(t) > 1]
    hits = [tokens[k] in CUE for k in at]
    telling = [tokens[k] in CUE and tokens[k] not in COMMON for k in at]
    if sum(hits) >= 2 and any(telling) and sum(hits) >= 0.6 * len(at):
        spot = [k for k, t in zip(at, telling) if t]
        return spot[0], spot[-1] + 1
    for n in (3, 4):
        for i in range(len(at) - n + 1):
            if sum(hits[i : i + n]) >= 3 and sum(telling[i : i + n]) >= n - 2:
                first = next(k for k in range(i, i + n) if hits[k])
                last = next(k for k in range(i + n - 1, i - 1, -1) if hits[k])
                return at[first], at[last] + 1
    return 0, 0


def reports(tokens: list[str], start: int, end: int) -> bool:
    """Whether words report on something: a reporting word among them or just before."""
    return any(t in REPORTS for t in tokens[max(0, start - 2) : end])


def near(a: str, b: str, most: int) -> bool:
    """Whether b is at most `most` insertions, deletions, changes or swaps of neighbours away from a."""
    if abs(len(a) - len(b)) > most:
        return False
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if prev2 is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, prev2[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return False
        prev2, prev = prev, row
    return prev[-1] <= most


def _right(cache: dict[str, str], token: str) -> str:
    if token in _KNOWN:
        return token
    put = cache.get(token)
    if put is None:
        close = []
        for k in dict.fromkeys(k for ch in dict.fromkeys(token[:2]) for k in _LONG.get(ch, ())):
            for most in (1, 2) if len(k) >= 8 else (1,):
                if near(token, k, most):
                    close.append((most, -len(k), k))
                    break
        put = min(close)[2] if close else token
        if len(cache) < 200_000:
            cache[token] = put
    return put


def fold_text(text: str) -> str:
    text = html.unescape(html.unescape(text))
    text = unicodedata.normalize("NFKC", text).lower()
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", text).strip()


def says_nothing(folded: str) -> bool:
    """Whether a folded field is marks only, or nothing but words that stand for no value."""
    plain = _MARKS.sub(" ", folded).strip()
    return not plain or _WHOLE.match(plain) is not None


def strong(folded: str) -> bool:
    return says_nothing(folded) or _LITERAL.search(folded) is not None or any(mark in folded and p.search(folded) for mark, p in _STRONG) or _mashed(folded)


def weak(righted: str, about: frozenset[str] | set[str]) -> tuple[int, int, str] | None:
    """(terms shared with the record's address and title, content words, words) of the weak segment that tells most, if any."""
    found = []
    for segment in _SEGMENT.split(righted):
        tokens = _LETTERS.findall(segment)
        start, end = cued(tokens)
        if end and reports(tokens, start, end):
            continue
        form = None if end else next((m for p in _WEAK if (m := p.search(segment))), None)
        if form:
            start = len(_LETTERS.findall(segment[: form.start()]))
            end = start + max(1, len(_LETTERS.findall(form.group())))
        if end:
            told = [t for t in tokens[start:end] if t not in LINKS]
            found.append((len(about.intersection(told)), len(told), " ".join(tokens[start:end])))
    return min(found, default=None)


def _read(text: str, cache: dict) -> tuple[int, str]:
    """(2 for a strong sign, 0 for no text, else 1, the folded text with misspelt cues put right)."""
    folded = fold_text(text)
    if not folded:
        return 0, ""
    if _TODO.search(text) or strong(folded):
        return 2, ""
    righted = _TOKEN.sub(lambda m: _right(cache, m.group()), folded)
    return (2, "") if righted != folded and strong(righted) else (1, righted)


def detect(text: str, about: frozenset[str] | set[str] = frozenset(), cache: dict | None = None) -> tuple[int, int, int, str]:
    """(sign, shared, terms, words): sign 2 for a strong sign, 1 for a weak segment, else 0."""
    cache = {} if cache is None else cache
    read = cache.get((text,)) if len(text) < 500 else None
    if read is None:
        read = _read(text, cache)
        if len(text) < 500 and len(cache) < 200_000:
            cache[text,] = read
    sign, righted = read
    if sign != 1:
        return sign, 0, 0, ""
    told = weak(righted, about)
    return (1, *told) if told else (0, 0, 0, "")


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, str] = {}
    for batch in batches:
        told = [detect(t, frozenset(about), cache) for about, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        sign, shared, terms, said = zip(*told) if told else ((),) * 4
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sign, pa.int32()), pa.array(shared, pa.int32()), pa.array(terms, pa.int32()), pa.array(said, pa.string())], names=["source_uid", "campo", "host", "sign", "shared", "terms", "said"])


def evidence(sources: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(source_uid, campo, sign, shared, terms, same) of every field that is neither null nor blank.

    `same`: how many fields of the host hold the same weak segment, counted over groups combined before the shuffle; only
    weak segments take part, and only those that repeat are met again.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in sources.columns else F.lit("")
    address = fold(F.concat_ws(" ", *[F.regexp_replace(text(c), r"[_/.\-]+", " ") for c in ("source_key", "name", "path", "filename")]))
    about = F.array_distinct(F.filter(words(address), lambda t: (F.length(t) > 3) & ~t.rlike(r"^\d+$")))
    held = [c for c in fields if c in sources.columns]
    long = sources.select(F.col("source_uid").cast("bigint").alias("source_uid"), text("source_type").alias("host"), about.alias("about"), *[F.col(c).cast("string").alias(c) for c in held])
    long = long.unpivot(["source_uid", "host", "about"], held, "campo", "body").where(F.length(F.trim(F.regexp_replace("body", r"[\s\u00A0]+", " "))) > 0)
    signed = long.select("source_uid", "campo", "host", "about", "body").mapInArrow(_signs, "source_uid bigint, campo string, host string, sign int, shared int, terms int, said string")
    signed = materialize(signed.withColumn("said", F.when(F.col("sign") == 1, F.xxhash64("host", "said"))), "signed")
    repeated = signed.where("said is not null").groupBy("said").agg(F.count("*").alias("same")).where("same > 1")
    return signed.join(repeated, "said", "left").select("source_uid", "campo", "sign", "shared", "terms", F.coalesce("same", F.lit(1)).alias("same"))


def flagged(told: DataFrame) -> DataFrame:
    """(source_uid, campo), each once, of the fields that hold residue."""
    mismatched = F.col("shared") == 0
    low = (F.col("terms") <= LOW_INFORMATION) | (F.col("same") >= DUPLICATED)
    return told.where((F.col("sign") == 2) | (F.col("sign") == 1) & mismatched & low).select("source_uid", "campo").distinct()
