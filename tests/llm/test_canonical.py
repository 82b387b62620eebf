import random

import pytest

from lavra.llm import canonical

ENTRIES = [
    (1, "Rádio transceptor naval", None), (2, "Rádio transceptor portátil", None), (3, "Rádio transceptor veicular RT-823", "RT-823"), (4, "Antena dipolo de longo alcance", None), (5, "Fone com microfone compacto LH-267", "LH-267"), (6, "Gerador diesel estanque", None), (7, "Painel solar dobrável KF-74", None),
]
UNITS = [(11, "9º Esquadrão de Vigilância Morro Cinza", "9 ESQVIG MC"), (12, "26º Companhia de Apoio Logístico Furo Largo", "26 CALOG FL"), (13, "9º Parque de Manutenção Mata Bravia", "9 PQMNT MB")]


@pytest.mark.parametrize("value,ref", [
    ("RADIO TRANSCEPTOR NAVAL", 1), ("Rdio transceptor navla", 1), ("Rd trnscptr nvl", 1), ("naval, Rádio transceptor", 1), ("cx. Rádio transceptor naval (novo)", 1), ("12 un. Rádio_transceptor_naval - LOTE 7", 1), ("RÃ¡dio transceptor naval / NF 88", 1),
    ("Rádio transceptor port...", 2), ("Rádio transceptor veicular rt 823", 3), ("RT823", 3), ("rt-823, Rad. transc. veic.", 3), ("Rádio transceptor veicular RT-824", 0), ("Rádio transceptor naval RT-900", 0), ("Antena dipolo longo alcance", 4), ("Antenadipolode longo alcance", 4),
    ("Fone micr. comp. LH/267", 5), ("grdr dsl estnq", 6), ("Extintor de pó 12 kg", 0), ("ver NF 828", 0), ("n/i", 0), ("?", 0), ("KF-74", 7), ("Rádio transceptor", 0),
])
def test_items(value, ref):
    assert canonical.Mapper(ENTRIES).resolve(value) == ref


@pytest.mark.parametrize("value,ref", [("9o. Esqd de Vig Morro Cinza", 11), ("Morro Cinza - 9º Esquadrao de Vigilancia", 11), ("9 esqvig mc", 11), ("10º Esquadrão de Vigilância Morro Cinza", 0), ("26Âº Cia de Ap Log Furo Largo", 12), ("9º Pq de Mnt Mata Bravia", 13), ("9º Parque de Manutenção Morro Cinza", 0), ("Feira do Produtor Mata Bravia", 0), ("9", 0)])
def test_units(value, ref):
    assert canonical.Mapper(UNITS).resolve(value) == ref


def test_cells_and_edges(spark):
    rows = spark.createDataFrame([(1, "Rádio transceptor naval", None, 1), (2, "radio transceptor naval", "", 0), (3, None, " ", 0), (4, "radio transceptor naval", " ", 0), (5, "x" * 100_000, "nada", 0)], "dist_id bigint, item string, subsistema string, ref_id int")
    refs = spark.createDataFrame([(i, "item", n, a, "x") for i, n, a in ENTRIES], "ref_id bigint, campo string, canonical string, alias string, value string")
    fields = ("item", "subsistema")
    resolved = canonical.resolve(canonical.distinct_values(rows, fields, refs), refs)
    got = {tuple(r) for r in canonical.map_cells(rows, resolved, "dist_id", fields).collect()}
    assert got == {(2, "item", 1), (4, "item", 1), (5, "item", 0), (5, "subsistema", 0)}
    assert canonical.resolve(canonical.distinct_values(rows.limit(0), fields, refs), refs).count() == 0
    assert {r.ref_id for r in canonical.resolve(canonical.distinct_values(rows, fields, refs.limit(0)), refs.limit(0)).collect()} == {0}


def test_held_out_noise(spark, data):
    """Canonical names with invented noise must come back; names with another code must not."""
    import pandas as pd

    refs = pd.read_parquet(f"{data}/ref_entries.parquet")
    rng = random.Random(3)
    right = wrong = total = 0
    for campo, part in refs.groupby("campo"):
        m = canonical.Mapper([(int(a), b, c if isinstance(c, str) else None) for a, b, c in zip(part.ref_id, part.canonical, part.alias)])
        for ref, name in zip(part.ref_id, part.canonical):
            i = rng.randrange(3, len(name) - 8) if len(name) > 12 else 3
            value = name[:i] + name[i + 1] + name[i] + name[i + 2 :] if name[i].isalpha() and name[i + 1].isalpha() else name.lower()
            got = m.resolve(value)
            total += 1
            right += got == ref
            wrong += got not in (0, ref)
    assert right / total > 0.97 and wrong / total < 0.01


@pytest.mark.parametrize("value,stage,ref", [
    ("radio transceptor naval", "name", 1), ("segue Rádio transceptor naval hoje", "embedded", 1), ("Rdio transc. veicular RT-823", "embedded", 3), ("LH-267 fone c/ microfone", "embedded", 5), ("Uniforme de gala LH-267", "none", 0), ("Rádio transceptor naval dipolo", "none", 0), ("Rad transc naval", "similar", 1), ("Bolsa", "none", 0),
])
def test_stages(value, stage, ref):
    m = canonical.Mapper(ENTRIES)
    assert m.resolve(value) == ref and (m.read(value)[0] if ref else "none") == stage


def test_tokens_alike():
    like = canonical.tokens_alike
    assert like("radio", "radio") == 1 and like("rd", "radio") == 0.9 and like("transc", "transceptor") == 0.9 and like("trasnceptor", "transceptor") > 0.6 and like("naval", "dipolo") == 0 and like("", "x") == 0


@pytest.mark.parametrize("rows", [2, 3, 5])
def test_lists_in_blocks_read_as_one(spark, monkeypatch, rows):
    values = [v for v, _ in [("RADIO TRANSCEPTOR NAVAL", 1), ("Rdio transceptor navla", 1), ("Rádio transceptor", 0), ("rt 823", 3), ("grdr dsl estnq", 6), ("Rd trnscptr", 0), ("LH-267 fone c/ microfone", 5), ("nada", 0), ("Painel slar dobr KF74", 7)]]
    cells = spark.createDataFrame([("item", v) for v in values] + [("om_destino", "9o. Esqd de Vig Morro Cinza"), ("om_destino", "Morro Cinza")], "campo string, value string")
    refs = spark.createDataFrame([(i, "item", n, a) for i, n, a in ENTRIES] + [(i, "om_destino", n, a) for i, n, a in UNITS], "ref_id bigint, campo string, canonical string, alias string")
    whole = {tuple(r) for r in canonical.resolve(cells, refs).collect()}
    monkeypatch.setattr(canonical, "REFERENCE_ROWS", rows)
    assert {tuple(r) for r in canonical.resolve(cells, refs).collect()} == whole and len(whole) == len(values) + 2
