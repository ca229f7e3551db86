import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from concilia import schemas
from concilia.functions.prepare import prepare_members, prepare_registry
from concilia.operators import rejections
from concilia.operators.versions import latest_version
from concilia.plans.catalogue import BY_ID
from concilia.sources import rejection_xml, sinks, tables
from concilia.streaming.pending import resolve_stream
from concilia.streaming.registry import newest_versions
from concilia.streaming.rejections import stream_rejections
from tests.helpers import context, ids, member, plan_of, table, version

HEAD = """<?xml version="1.0" encoding="{encoding}"?>
<mensagemSIB><cabecalho><identificacaoTransacao><tipoTransacao>{kind}</tipoTransacao>
<sequencialTransacao>7</sequencialTransacao></identificacaoTransacao><origem><cnpj>11</cnpj></origem>
<versaoPadrao>1.1</versaoPadrao></cabecalho><mensagem><resultadoProcessamento>"""
BODY = """<arquivoProcessado><protocoloProcessamento><numeroProtocolo>123</numeroProtocolo>
<nomeArquivo>a.sbx</nomeArquivo></protocoloProcessamento><registrosRejeitados>
<registroRejeitado cco=" C1 " codigoBeneficiario="01" codigoTipoMovimento="3" tipoMovimento="EXCLUSÃO">
<campoErro><codigoCampo>10</codigoCampo><descricaoCampo>Situação</descricaoCampo><valorCampo>x</valorCampo>
<erro><codigoErro>3005</codigoErro><mensagemErro>já</mensagemErro></erro><erro><codigoErro>9999</codigoErro></erro>
</campoErro><campoErro><codigoCampo>11</codigoCampo><erro><codigoErro>0205</codigoErro></erro>
<erro><codigoErro>3205</codigoErro></erro></campoErro></registroRejeitado>
<registroRejeitado cco="" codigoBeneficiario="02" codigoTipoMovimento="1"></registroRejeitado>
</registrosRejeitados><registrosIncluidos><registroIncluido codigoBeneficiario="03"><cco>C9</cco>
<nomeBeneficiario>JOSÉ</nomeBeneficiario></registroIncluido></registrosIncluidos><consolidado>
<consolidadoErroProcessamento><erro><codigoErro>0205</codigoErro><quantidadeOcorrenciaErro>1</quantidadeOcorrenciaErro></erro>
<erro><codigoErro>3005</codigoErro><quantidadeOcorrenciaErro>5</quantidadeOcorrenciaErro></erro>
</consolidadoErroProcessamento><consolidadoProcessamento><consolidadoInclusao>
<quantidadeRegistros>10</quantidadeRegistros><percentualAcerto>90.5</percentualAcerto></consolidadoInclusao>
<consolidadoTotal><quantidadeRegistros>10</quantidadeRegistros></consolidadoTotal></consolidadoProcessamento>
</consolidado></arquivoProcessado>"""
TAIL = "</resultadoProcessamento></mensagem><epilogo><hash>abc</hash></epilogo></mensagemSIB>"


def write(folder, name, kind="RESULTADO DO PROCESSAMENTO", encoding="ISO-8859-1", body=BODY):
    with open(f"{folder}/{name}", "w", encoding=encoding) as out:
        out.write(HEAD.format(encoding=encoding, kind=kind) + body + TAIL)


def name_of(path):
    return path.rsplit("/", 1)[1]


def test_rejection_files(spark, folder):
    write(folder, "a.RPX")
    write(folder, "b.xml", kind="ENVIO")
    write(folder, "c.RPX", body="")
    with open(f"{folder}/d.RPX", "w") as out:
        out.write("<outro/>")
    write(folder, "e.txt")
    rows = rejection_xml.read_rejections(spark, f"{folder}/a.RPX").collect()
    assert [(r.cco, len(r.erros), r.tipo_movimento) for r in rows] == [
        ("C1", 4, "EXCLUSÃO"), ("", 0, "")]
    assert [e.codigo_erro for e in rows[0].erros] == ["3005", "9999", "0205", "3205"]
    assert rows[0].erros[1].descricao_campo == "Situação"
    included = rejection_xml.read_inclusions(spark, f"{folder}/a.RPX").first()
    assert (included.cco, included.nome_beneficiario) == ("C9", "JOSÉ")
    valid = rejection_xml.read_file_headers(spark, folder).collect()
    assert [(name_of(r.arquivo), r.numero_protocolo, r.hash) for r in valid] == [
        ("a.RPX", "123", "abc")]
    wrong = rejection_xml.invalid_files(spark, folder).collect()
    assert sorted(name_of(r.arquivo) for r in wrong) == ["b.xml", "c.RPX", "d.RPX"]
    totals = rejection_xml.read_error_totals(spark, f"{folder}/a.RPX").collect()
    assert [(r.codigo_erro, r.quantidade, r.severidade) for r in totals] == [
        ("3005", 5, "media"), ("0205", 1, "alta")]
    moves = {r.tipo: r for r in rejection_xml.read_movement_totals(
        spark, f"{folder}/a.RPX").collect()}
    assert moves["Inclusao"].percentual_acerto == 90.5
    assert moves["Total"].quantidade_registros == 10


def test_encoding_is_chosen(spark, folder):
    write(folder, "u.RPX", encoding="UTF-8")
    row = rejection_xml.read_rejections(spark, folder, encoding="UTF-8").first()
    assert row.tipo_movimento == "EXCLUSÃO"


def test_rows_of_invalid_files_are_not_read(spark, folder):
    write(folder, "a.RPX")
    write(folder, "b.RPX", kind="ENVIO")
    write(folder, "c.RPX", kind="")
    with open(f"{folder}/d.RPX", "w") as out:
        out.write(f"<outro>{BODY}</outro>")
    open(f"{folder}/e.RPX", "w").close()
    for read, n in ((rejection_xml.read_rejections, 2), (rejection_xml.read_inclusions, 1),
                    (rejection_xml.read_error_totals, 2), (rejection_xml.read_movement_totals, 2)):
        got = [name_of(r.arquivo) for r in read(spark, folder).collect()]
        assert sorted(got) == ["a.RPX"] * n + ["c.RPX"] * n


def test_a_large_file_is_read_by_several_tasks(spark, folder):
    record = (
        '<registroRejeitado cco="{0}" codigoBeneficiario="a&gt;b/" tipoMovimento="É">'
        "<campoErro><codigoCampo>{0}</codigoCampo><erro><codigoErro>3005</codigoErro></erro>"
        "</campoErro></registroRejeitado>"
    )
    records = [f'<registroRejeitado cco="{n}"/>' if n % 7 == 0 else record.format(n) for n in range(8000)]
    body = "<arquivoProcessado><registrosRejeitados>" + "\n".join(records)
    body += "</registrosRejeitados></arquivoProcessado>"
    write(folder, "large.RPX", body=body)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = rejection_xml.piece_reader(spark.read).load(folder)
        assert rows.select(F.spark_partition_id()).distinct().count() >= 4
        got = rejection_xml.read_rejections(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted(int(r.cco) for r in got) == list(range(8000))
    assert {(int(r.cco) % 7 == 0, len(r.erros), r.codigo_beneficiario) for r in got} == {
        (True, 0, ""), (False, 1, "a>b/")}


def test_stream_of_files_equals_batch(spark, folder):
    write(folder, "a.RPX")
    write(folder, "b.RPX")
    write(folder, "c.RPX", kind="ENVIO")
    got = []

    def each(rows, number):
        got.extend((r.cco, len(r.erros)) for r in rows.collect())

    writer = stream_rejections(spark, folder, each, files_per_trigger=1)
    run = writer.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start()
    run.awaitTermination()
    assert sorted(got) == [("", 0), ("", 0), ("C1", 4), ("C1", 4)]


def test_corrections_from_rejections(spark, folder):
    write(folder, "a.RPX")
    records = rejection_xml.read_rejections(spark, folder)
    rows = [
        member(1, posans="3-EXCLUSAO"), member(2, posans=None, codcco="C1 "), member(3),
        member(4, posans="8-REINCLUSAO"), member(5, posans="8-REINCLUSAO", codcco="C7"),
    ]
    ctx = context(spark, rows)
    m = prepare_members(ctx.members)
    principal = {r.cco: r for r in rejections.with_principal(records).collect()}
    assert principal["C1"].severidade == "media" and principal["C1"].fixable
    assert (principal[""].severidade, principal[""].titulo) == ("media", "")
    enriched = rejections.enrich(records, m, ("arquivo", "codigo_beneficiario"))
    assert {r.cco: r.cadusu_id for r in enriched.collect()} == {"C1": 1, "": None}
    assert rejections.matched(enriched).first().matched == 1
    settle = rejections.preview_fix(m, rejections.ccos_for_error(records, "3005"), "3005")
    assert ids(settle) == [1, 2, 4]
    renew = rejections.preview_fix(m, rejections.ccos_for_error(records, "3205"), "3205")
    assert ids(renew) == [4] and renew.first().codcco_novo == ""
    done = rejections.apply_fix(ctx.members, renew, "3205", ctx.day, ctx.moment, confirm=True)
    after = {r.id: r for r in done.collect()}
    assert after[4].codcco is None and after[4].posans == "1-INCLUSAO"
    assert after[5].codcco == "C7"
    with pytest.raises(ValueError):
        rejections.action_for("0205")
    with pytest.raises(ValueError):
        rejections.apply_fix(ctx.members, renew, "3205", ctx.day, ctx.moment)
    assert rejections.ccos_for_error(records, "1205").count() == 0
    eligible = {r.codigo_erro: r.elegiveis for r in
                rejections.eligible_by_code(records, m, "codigo_beneficiario").collect()}
    assert eligible == {"3005": 1, "3205": 0}


def test_records_without_a_key_are_dealt_out(spark, folder):
    """8,000 records with a blank CCO do not meet in one task."""
    write(folder, "a.RPX")
    one = rejection_xml.read_rejections(spark, folder).filter("cco = ''").limit(1)
    records = one.drop("codigo_beneficiario").crossJoin(spark.range(8000)).withColumn(
        "codigo_beneficiario", F.col("id").cast("string")).drop("id")
    m = prepare_members(context(spark, [member(1)]).members)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = rejections.enrich(records, m, "codigo_beneficiario")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 8000 and max(sizes) < 2000
    assert rejections.eligible_by_code(records, m, "codigo_beneficiario").count() == 0


def test_tiered_match_reads_the_registry_once_per_key(spark, derived):
    from concilia.functions.predicates import compatible_keys
    from concilia.operators.matching import tiered_match

    status = F.when(F.col("situusu") == "ATIVO", "I").when(F.col("situusu") == "INATIVO", "A")
    rows = tiered_match(derived.m, derived.r, compatible_keys(), status)
    assert plan_of(rows).count("FileScan") <= 6


def test_stream_of_versions_equals_batch(spark, folder):
    registry = table(spark, schemas.REGISTRY, [
        version(n, codcco=f"C{n % 3}", status="AI"[n % 2]) for n in range(1, 20)
    ] + [version(None, codcco="C2", status="I")])
    rows = prepare_registry(registry).select("r_codcco", "r_numseq", "r_state")
    for part in range(3):
        rows.filter(F.coalesce("r_numseq", F.lit(0)) % 3 == part).write.mode("append").parquet(
            f"{folder}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{folder}/in")
    run = (
        newest_versions(arriving, ["r_codcco"]).writeStream.outputMode("complete")
        .format("memory").queryName("newest").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").start()
    )
    run.awaitTermination()
    got = sorted(map(tuple, spark.table("newest").collect()), key=str)
    assert got == sorted(map(tuple, latest_version(rows, ["r_codcco"]).collect()), key=str)


def test_stream_of_waiting_corrections(spark, folder):
    day = datetime(2001, 1, 1)

    def at(number):
        return day.replace(month=1 + (number - 1) // 28, day=1 + (number - 1) % 28)

    applied = [(1, "r", "C1", "A", at(1)), (2, "r", "C2", "A", at(1)), (3, "r", "C3", "A", at(2)),
               (4, "r", "C4", "A", at(1)), (4, "r", "C4", "A", at(40)), (4, "x", "C4", "A", at(1)),
               (5, "r", None, "A", at(1)), (9, "r", "C9", "A", at(300))]
    events = [("C1", "A", at(5)), ("C1", "A", at(6)), ("C2", "I", at(5)), ("C3", "A", at(60)),
              ("C4", "A", at(60)),
              ("C8", "A", at(300))]
    spark.createDataFrame(
        applied, "cadusu_id long, rule_id string, k_cco string, expected string, applied_at timestamp"
    ).write.parquet(f"{folder}/applied")
    spark.createDataFrame(events, "r_cco string, r_state string, loaded_at timestamp").write.parquet(
        f"{folder}/events")
    left = spark.readStream.schema(spark.read.parquet(f"{folder}/applied").schema).parquet(
        f"{folder}/applied")
    right = spark.readStream.schema(spark.read.parquet(f"{folder}/events").schema).parquet(
        f"{folder}/events")
    run = (
        resolve_stream(left, right).writeStream.format("memory").queryName("waited")
        .trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start()
    )
    run.awaitTermination()
    got = sorted((r.cadusu_id, r.rule_id, r.status) for r in spark.table("waited").collect())
    assert got == [  # renewed within its wait and then reflected: one row, resolved
        (1, "r", "resolvido"), (2, "r", "expirado"), (3, "r", "expirado"), (4, "r", "resolvido"),
        (4, "x", "expirado"), (5, "r", "expirado")]


def test_csv(spark, folder):
    df = spark.createDataFrame([(1, "a;b", None), (2, "É", "x")], "id long, t string, n string")
    sinks.write_csv(df.coalesce(1), f"{folder}/csv", bom=True)
    text = open(glob.glob(f"{folder}/csv/part-*")[0], encoding="utf-8").read()
    assert text == '\ufeffid;t;n\n1;"a;b";\n2;É;x\n'
    many = spark.range(1000).repartition(4)
    sinks.write_csv(many, f"{folder}/many", bom=True)
    parts = [open(p, encoding="utf-8").read() for p in glob.glob(f"{folder}/many/part-*")]
    assert len(parts) == 4 and all(p.startswith("\ufeffid\n") for p in parts)
    assert sum(p.count("\n") - 1 for p in parts) == 1000


def test_snapshots_are_never_overwritten(spark, folder, derived):
    sinks.write_snapshot(derived.contracts, f"{folder}/s")
    with pytest.raises(Exception):
        sinks.write_snapshot(derived.contracts, f"{folder}/s")


def test_tables_read_back(spark, folder):
    ctx = context(spark, [member(1)], [version(1)], [{"codtit": "t"}], [])
    for name, df in (("cadusu", ctx.members), ("confsib", ctx.registry),
                     ("cadcont", ctx.contracts), ("pending", ctx.ledger)):
        df.write.parquet(f"{folder}/{name}")
    back = tables.read_tables(spark, folder, ctx.as_of, ctx.as_of_ts)
    assert back.members.schema.simpleString() == ctx.members.schema.simpleString()
    assert BY_ID["posans_desconhecido"].detail(back).count() == 0
    assert tables.conform(ctx.members, schemas.CONTRACTS.__class__(
        [schemas.MEMBERS["id"]])).columns == ["id"]


def test_bucketed_tables_need_no_shuffle_for_newest_versions(spark, derived):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sinks.save_bucketed(derived.registry, "registry_by_cco", "codcco", 8)
        r = prepare_registry(spark.table("registry_by_cco"))
        newest = latest_version(r.select("r_codcco", "r_numseq", "r_state"), ["r_codcco"])
        assert "Exchange" not in plan_of(newest)
        want = latest_version(
            prepare_registry(derived.registry).select("r_codcco", "r_numseq", "r_state"),
            ["r_codcco"])
        assert newest.exceptAll(want).count() == want.exceptAll(newest).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_header_that_names_a_registro_ans_is_whole(spark, folder):
    """The name begins like the end of a record, where files are cut."""
    from concilia.sources import rejection_xml

    head = (
        "<mensagemSIB><cabecalho><identificacaoTransacao><tipoTransacao>RESULTADO</tipoTransacao>"
        "<sequencialTransacao>7</sequencialTransacao></identificacaoTransacao><origem>{origin}</origem>"
        "<destino><registroANS>123456</registroANS></destino><versaoPadrao>1.1</versaoPadrao></cabecalho>"
        "<mensagem><arquivoProcessado><registrosRejeitados><registroRejeitado cco='1'/></registrosRejeitados>"
        "</arquivoProcessado></mensagem></mensagemSIB>"
    )
    for name, origin in (("a", "<cnpj>1</cnpj>"), ("b", "<registroANS>99</registroANS><cnpj>1</cnpj>")):
        with open(f"{folder}/{name}.xml", "w", encoding="latin-1") as out:
            out.write(head.format(origin=origin))
    rows = rejection_xml.read_file_headers(spark, folder).collect()
    assert {(r.tipo_transacao, r.sequencial, r.cnpj_origem, r.registro_ans, r.versao_padrao) for r in rows} == {
        ("RESULTADO", "7", "1", "123456", "1.1")
    } and len(rows) == 2
    assert [r.cco for r in rejection_xml.read_rejections(spark, folder).collect()] == ["1", "1"]


def test_csv_keeps_blanks_at_the_ends(spark, folder):
    df = spark.createDataFrame([(" a ", None), ("", "b ")], "x string, y string")
    sinks.write_csv(df, f"{folder}/csv")
    back = spark.read.option("sep", ";").option("header", True).csv(f"{folder}/csv")
    assert sorted(map(tuple, back.na.fill("").collect())) == [("", "b "), (" a ", "")]


def test_streams_over_parts_of_a_folder_run_together(spark, folder):
    """Each has its own checkpoint and batches; every row is handed out once, now and later."""
    from concilia.streaming.rejections import finish_together

    def batches(prefix):
        name = f"{folder}/{{}}/part={prefix}"
        rows = spark.readStream.schema("n long").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in/{prefix}*")
        return rows.writeStream.foreachBatch(lambda batch, number: batch.write.parquet(f"{name.format('out')}/batch={number}"))

    def arrive(names):
        for name in names:
            spark.range(3).select((F.col("id") * 10 + int(name[1:])).alias("n")).coalesce(1).write.parquet(f"{folder}/in/{name}")
        finish_together({prefix: batches(prefix) for prefix in "abc"}, f"{folder}/state")
        return sorted(r.n for r in spark.read.parquet(f"{folder}/out").collect())

    want = lambda *ends: sorted(10 * i + e for i in range(3) for e in ends)
    assert arrive(["a0", "a1", "a2", "b3"]) == want(0, 1, 2, 3)
    assert arrive(["b4", "a5"]) == want(0, 1, 2, 3, 4, 5)
