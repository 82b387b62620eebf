import pytest

from lavra.llm import residue

BAD = [
    "[[MANUAL]]", "<assunto>", "&lt;when_to_use&gt;", "Cadastro de {0} e {1} do setor", "Tabela ${tabela} do setor @@setor@@", "%%TODO%%", "__preencher__", "#descricao#", "Saldos de «inserir grupo» por depósito", "Dados de :assunto no período :periodo", "Fonte %s com %d linhas", "[tema]",
    "Descreva aqui o papel da fonte", "a preencher pelo setor responsável", "Preencher depois", "Insira entre vinte e quarenta palavras", "(sem descrição - completar)", "Conteúdo a definir pelo setor", "lorem ipsum dolor", "asdf qwer", "teste teste", "XXXXXXXX", "TBD", "N/A", "null", "-", "....", "Fulano de Tal, setor tal",
    "404 - página não encontrada", "HTTP 403 acesso negado, faça login", "502 bad gateway", "Sua sessão expirou.", "KeyError: 'results'", "We could not render your data", "Ative o JavaScript para ver esta página", "This site needs client-side scripts", "Seu navegador bloqueou scripts", "habilte scripts no navegdor e recarregue",
    "Registro oficial de contratos O browser em uso desativou scripts de fornecimento.",
]
GOOD = [
    "Registro oficial de contratos de fornecimento.", "Traz códigos 404, 500 e 502 de prateleira.", "Os campos [A] e [B] indicam a classe do material.", "Acesso negado é um dos estados do controle de portaria.", "O painel foi escrito em JavaScript e lê estes dados.", "Lista navegadores de bordo (GPS) e scripts de rota.",
    "O operador preenche o campo descrição à mão.", "O valor fica na faixa {min,max} do sensor.", "Mostra %umidade e %carga de cada bateria.", "Para <5 kg usa-se a caixa pequena.", "O campo pendente indica pedido ainda não atendido.", "Exige scripts de carga assinados pelo setor.", "Conta falhas do servidor interno por semana.",
    "A coluna status_http mostra quantas vezes houve erro 404 em cada coleta.", "Reúne textos de teste e de exemplo gravados pelos operadores.", "Lista as páginas do relatório não encontradas no arquivo físico.",
]


#: Wordings that were not looked at while the detectors were made.
HELD_OUT = [
    "Página indisponível no momento.", "Please enable scripts in your browser.", "Complete este campo mais tarde", "Escreva um resumo da tabela", "HTTP error 503", "Erro ao carregar a página", "Servidor indisponível, tente novamente", "Login expirado, entre novamente", "This page requires JavaScript", "<inserir descrição>",
    "{{source_name}}", "Lorem ipsum dolor sit amet", "TODO: write description", "Scripts estão desativados neste navegador", "Enable cookies to continue", "Access denied", "Connection reset by host", "The requested page was not found", "Conteúdo removido desta página", "Erro 500 no servidor", "[insert text]", "${descricao}",
    "zxcvb", "sdf sdf jkl", "foo foo", "Não informado", "n/d", "%%NOME%%", "Preencha o campo com a descrição", "Gateway timeout", "Ative scripts e recarregue a página", "Token inválido, faça login", "a inserir", "<<resumo>>", "________",
]


def caught(text, about=frozenset()):
    sign, shared, terms, _ = residue.detect(text, about)
    return sign == 2 or sign == 1 and not shared and terms <= residue.LOW_INFORMATION


@pytest.mark.parametrize("text", BAD)
def test_residue_is_caught(text):
    assert caught(text)


@pytest.mark.parametrize("text", GOOD)
def test_real_content_is_not(text):
    assert not caught(text)


def test_held_out_wordings():
    lost = [t for t in HELD_OUT if not caught(t)]
    assert len(lost) <= 0.1 * len(HELD_OUT), lost


def test_evidence_decides_on_weak_segments():
    notice = "Erro na conexão com o servidor"
    assert residue.detect(notice)[0] == 1 and caught(notice)
    assert not caught(notice, frozenset(["servidor", "erro"]))  # a source about errors of servers may say so
    assert not caught("Registra cada erro de conexão com o servidor.")


@pytest.mark.parametrize("k", [1, 8, 9, 100])
def test_non_values_however_many(k):
    assert caught("sem informacao " * k) and caught("n/a; " * k) and not caught("sem informacao " * k + "sobre viaturas")


def test_fields_and_evidence(spark):
    rows = [(1, "sql", "tb_lotes_1", "tb lotes 1", "Lotes importados.", None, " ", "TBD", "x"), (1, "sql", "tb_lotes_1", "tb lotes 1", "Lotes importados.", None, " ", "TBD", "x"), (2, None, None, None, "Texto provisório", "", " ", "a" * 300_000, "y")]
    df = spark.createDataFrame(rows, "source_uid bigint, source_type string, source_key string, name string, description string, business_role string, when_to_use string, embedding_hint string, body string")
    told = residue.evidence(df)
    assert {(r.source_uid, r.campo) for r in told.collect()} == {(1, "description"), (1, "embedding_hint"), (2, "description"), (2, "embedding_hint")}
    assert {tuple(r) for r in residue.flagged(told).collect()} == {(1, "embedding_hint"), (2, "description"), (2, "embedding_hint")}
    assert residue.flagged(residue.evidence(df.limit(0))).count() == 0
    assert residue.flagged(residue.evidence(df.drop("path", "name", "source_key", "source_type"))).count() == 3


def test_address_and_host_count(spark):
    long = "Página com erro ao abrir view, portal, navegador, script, login, sessão, token, cookies e conteúdo do servidor"
    rows = [(i, "api", f"k{i}", f"/portal/{i}" if i == 9 else f"/x/{i}", long) for i in range(1, 10)] + [(20, "sql", "k", "/y", long)]
    df = spark.createDataFrame(rows, "source_uid bigint, source_type string, source_key string, path string, description string")
    # too long to count by itself: repeated in its host it does, unless the address speaks of it
    assert {r.source_uid for r in residue.flagged(residue.evidence(df)).collect()} == set(range(1, 9))


def test_near():
    assert residue.near("abcd", "abdc", 1) and residue.near("abcd", "abc", 1) and not residue.near("abcd", "dcba", 2)
