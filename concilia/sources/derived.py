"""Member, registry, contract and ledger tables derived from customers and orders.

Customers become members, orders become registry versions (about ten per member), and the
remainder of the key by 61 plants one situation per bucket. One recipe, two SQL dialects,
so that a second engine can check every result on the very same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from concilia import schemas
from concilia.operators.rejections import ERROR_CODES
from concilia.plans.context import Reconciliation
from concilia.session import adapt, shared_folder
from concilia.sources.rejection_xml import shape_rejections
from concilia.sources.tables import conform, read_tables

AS_OF = "2001-10-31"
AS_OF_TS = "2001-10-31 12:00:00"

#: A file is one row group, which one task reads whole, however small its splits are.
ROWS_PER_FILE = 50_000


class _Dialect:
    def __init__(self, duckdb: bool):
        self.text = "varchar" if duckdb else "string"
        self.duckdb = duckdb

    def day(self, base: str, offset: str) -> str:
        if self.duckdb:
            return f"(date '{base}' + cast({offset} as int))"
        return f"date_add(date '{base}', cast({offset} as int))"

    def moment(self, hours: str) -> str:
        """AS_OF_TS minus some hours."""
        if self.duckdb:
            return f"(timestamp '{AS_OF_TS}' - to_hours(cast({hours} as int)))"
        return f"(timestamp '{AS_OF_TS}' - make_dt_interval(0, cast({hours} as int)))"

    def t(self, expr: str) -> str:
        return f"cast({expr} as {self.text})"


def _br(day: str) -> str:
    return f"(substr({day},9,2) || '/' || substr({day},6,2) || '/' || substr({day},1,4))"


def members_sql(duckdb: bool = False, customer: str = "customer") -> str:
    d = _Dialect(duckdb)
    flags = ", ".join(
        f"case when b = 26 and k % 2 = 0 then null when b = 26 then ' ' else '0' end as {f}"
        for f in (
            "ansrg", "anscpf", "ansmae", "anscns", "ansparentesco", "anstitular", "ansplano",
            "ansdataini", "ansdatafim", "anscnpjcei",
        )
    )
    return f"""
select id,
 codtit, codusu,
 case when b = 1 then 'PESSOA 9 ' || al when b = 2 then '' when b = 19 then 'José D''Ávila ' || al
      else 'PESSOA ' || al end as nomeusu,
 case when b = 41 then 'MARIA' when b = 42 then 'MAE 2 X' when b = 20 then 'MÃE DA  ' || al
      when b = 29 then ' MAE# ' || al else 'MAE ' || al end as mae,
 case when b in (3,4,5,6,7,8,9,10,11,12,60) then 'INATIVO' when b in (13,14) then 'BLOQUEADO'
      else 'ATIVO' end as situusu,
 case when b in (3,15,16,17,18) then '1-INCLUSAO' when b in (4,13,19,9,11) then '3-EXCLUSAO'
      when b in (20,5,60,36) then '2-ALTERACAO' when b in (21,22,23,24) then '8-REINCLUSAO'
      when b in (14,25) then '9-RET REATIV' when b in (26,27) then '10-SIB-FLEX'
      when b in (46,48) and k % 2 = 0 then '10-SIB-FLEX'
      when b = 28 then 'LEGADO' when b = 29 then null else '4-ATUALIZADO' end as posans,
 case when b in (3,4,16,30,31,55) then null when b in (56,57) then '' when b in (5,17,18,58) then '  '
      when b = 32 then lpad({d.t('id + 1')},12,'0') when b = 36 then ' ' || lpad({d.t('id')},12,'0')
      else lpad({d.t('id')},12,'0') end as codcco,
 case when b in (33,60,55,56) then null when b = 57 then 'X' || codtit when b = 59 then ' '
      else codtit || '-' || codusu end as codans,
 case when b in (34,31,56) then null when b = 35 then '1' || lpad({d.t('k')},10,'0') || '-'
      when b in (52,54) then lpad({d.t('k - 1')},11,'0')
      when b = 57 then lpad({d.t('k + 500000000')},11,'0')
      when b = 37 then substr(lpad({d.t('k')},11,'0'),1,3) || '.' || substr(lpad({d.t('k')},11,'0'),4)
      else lpad({d.t('k')},11,'0') end as cpfusu,
 case when b in (31,39) then null when b = 35 then '' else '7' || lpad({d.t('k')},14,'0') end as cns,
 'RG-' || {d.t('k')} as rgusu,
 case when b = 39 then null when k % 2 = 0 then 'M' else 'F' end as sexousu,
 'PL' || {d.t('k % 7')} as codplano, 'PL' || {d.t('k % 7')} as codplaport,
 case when k % 3 = 0 then 'TITULAR' else 'FILHO' end as parentesco,
 case when b = 38 then null when b = 54 then {d.day('1960-01-01', '(k - 1) * 37 % 15000')}
      else {d.day('1960-01-01', 'k * 37 % 15000')} end as nascusu,
 case when b in (18,40) then null when b in (23,24) then date '2001-10-01'
      else {d.day('2000-01-01', 'k % 300')} end as dataini,
 case when b in (6,7,8,21,22) then date '2001-09-30' else null end as datafim,
 case when b in (6,7) then date '2001-10-02' else null end as dataexc,
 cast(null as date) as datareinc,
 case when k % 4 = 0 then null else {d.day('2001-01-01', 'k % 200')} end as dataalt,
 case when k % 5 = 0 then null else {d.day('1999-12-01', 'k % 300')} end as datacad,
 case when b = 27 or (b = 46 and k % 2 = 0) then '1' else '0' end as ansnome,
 case when b = 48 and k % 2 = 0 then '1' else '0' end as ansnasc,
 {flags},
 cast(null as date) as dataultalt, cast(null as timestamp) as dtope
from (
 select c_custkey as k, c_custkey + 1 as id, c_custkey % 61 as b,
  lpad({d.t('cast(floor(c_custkey / 61) as int)')},4,'0') || '-'
   || lpad({d.t('cast(floor((c_custkey % 61) / 3) as int)')},4,'0') as codtit,
  lpad({d.t('c_custkey % 3')},2,'0') as codusu,
  translate({d.t('c_custkey')},'0123456789','ABCDEFGHIJ') as al
 from {customer}) z"""


def registry_sql(duckdb: bool = False, orders: str = "orders") -> str:
    d = _Dialect(duckdb)
    nd, di = d.t("nd"), d.t("di")
    return f"""
select case when b in (9,44,49) and first = 1 then null else o_orderkey + 1 end as numseq,
 case when b in (9,11,16,30,44,45,49,50,22,36,53) then 'I'
      when b in (6,7,8,15,17,21,23,14,25) then 'A'
      when o_orderstatus = 'F' then 'I ' else 'A' end as status,
 case when b = 43 or (b = 45 and o_orderkey % 2 = 0) then ''
      when b = 32 then lpad({d.t('k + 2')},12,'0')
      when b = 53 and o_orderkey % 2 = 1 then lpad({d.t('k + 1')},12,'0') || ' '
      else lpad({d.t('k + 1')},12,'0') end as codcco,
 codtit || '-' || lpad({d.t('k % 3')},2,'0') || case when b in (44,45) then 'X' else '' end as codusu,
 codtit,
 case when b in (10,46) then 'OUTRA ' || al
      when b = 12 and o_orderkey % 2 = 0 then 'ANTIGA ' || al
      when b = 19 then 'JOSÉ D''ÁVILA ' || al
      when b = 47 and o_orderkey % 3 = 0 then ' ' else 'PESSOA ' || al end as nomeusu,
 lpad({d.t('k')},11,'0') as cpfusu,
 '7' || lpad({d.t('k')},14,'0') as cns,
 case when k % 2 = 0 then 'M' else 'F' end as sexousu,
 'mae ' || al as mae,
 case when k % 3 = 0 then 'TITULAR' else 'FILHO' end as parentesco,
 'rg' || {d.t('k')} || case when b = 26 and k % 2 = 0 then '9' else '' end as docident,
 case when b = 47 then '31/02/1999' when b = 48 then '1950-01-01'
      when o_orderkey % 2 = 0 then {nd} else {_br(nd)} end as nascusu,
 case when b = 51 then ' ' when o_orderkey % 3 = 0 then {di} else {_br(di)} end as dataini,
 case when b in (9,11,22,36,49,50) then '30/09/2001' else '' end as datafim,
 case when k % 2 = 0 then 'PL' || {d.t('k % 7')} else '' end as codplaport,
 'PL' || {d.t('k % 7')} as codplaope,
 '11222333000144' as cnpj, 'N' as flag, 'R' || {d.t('o_orderkey % 4')} as registro
from (
 select o_orderkey, o_orderstatus, o_custkey as k, o_custkey % 61 as b,
  row_number() over (partition by o_custkey order by o_orderkey) as first,
  lpad({d.t('cast(floor(o_custkey / 61) as int)')},4,'0') || '-'
   || lpad({d.t('cast(floor((o_custkey % 61) / 3) as int)')},4,'0') as codtit,
  translate({d.t('o_custkey')},'0123456789','ABCDEFGHIJ') as al,
  {d.day('1960-01-01', 'o_custkey * 37 % 15000')} as nd, {d.day('2000-01-01', 'o_custkey % 300')} as di
 from {orders} where o_custkey % 61 <> 51) z
union all
select 900000000 + o_orderkey, case when o_orderkey % 2 = 0 then 'A' else 'I' end,
 case when o_orderkey % 4 < 2 then lpad({d.t('900000000 + o_orderkey')},12,'0') else '' end,
 'ZZ', null, 'SEM LOCAL', '', null, null, null, null, null, '', '', '', null, null, null, 'N', 'R9'
from {orders} where o_orderkey % 997 = 0"""


def contracts_sql(duckdb: bool = False, customer: str = "customer") -> str:
    """One contract per holder, some with an old title, some twice, some without."""
    members = members_sql(duckdb, customer)
    return f"""
select codtit,
 case when id % 7 = 3 then 'TITULO ANTIGO' else nomeusu end as nometit,
 timestamp '2001-01-01 00:00:00' as dtope
from ({members}) h where codusu = '00' and id % 11 <> 5
union all
select codtit, 'SEGUNDO ' || nomeusu, timestamp '2000-01-01 00:00:00'
from ({members}) h where codusu = '00' and id % 13 = 4"""


def ledger_sql(duckdb: bool = False, customer: str = "customer") -> str:
    """Corrections applied between some hours and four months before the clock."""
    d = _Dialect(duckdb)
    members = members_sql(duckdb, customer)
    applied = d.moment("id * 31 % 2880")
    until = d.moment("id * 31 % 2880 - 1080")
    return f"""
select id as cadusu_id,
 case when situusu = 'INATIVO' then 'inativo_cadusu_ativo_confsib'
      else 'ativo_inativo_confsib_reinclusao' end as rule_id,
 trim(codcco, ' ') as codcco,
 case when situusu = 'INATIVO' then '3-EXCLUSAO' else '8-REINCLUSAO' end as posans_aplicado,
 case when id % 9 = 8 then 'resolvido' else 'aguardando' end as status,
 {applied} as applied_at, {until} as wait_until,
 cast(case when id % 9 = 8 then timestamp '2001-10-01 00:00:00' end as timestamp) as resolved_at,
 'enviado' as note,
 case when id % 5 = 0 then null when id % 5 = 1 then 999999999 else id end as baseline_numseq
from ({members}) h
where codcco is not null and id % 61 in (7, 8, 9, 12, 37, 45, 50, 51, 53)""".replace(
        "trim(codcco, ' ')", "trim(codcco, ' ')" if duckdb else "trim(codcco)"
    )


def load(spark: SparkSession, sf_dir: str) -> Reconciliation:
    """The derived tables of one data directory, with the fixed clock.

    A deployment has these tables on disk. Here they are derived once per application and
    written to the shared folder, so that every query scans files: nothing is kept in the
    executors' memory.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        adapt(spark)
        customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        folder = f"{shared_folder(spark)}/derived-{uuid.uuid4().hex}"
        tables = {
            "cadusu": (schemas.MEMBERS, members_sql(customer="{customer}")),
            "confsib": (schemas.REGISTRY, registry_sql(orders="{orders}")),
            "cadcont": (schemas.CONTRACTS, contracts_sql(customer="{customer}")),
            "pending": (schemas.LEDGER, ledger_sql(customer="{customer}")),
        }
        for name, (schema, sql) in tables.items():
            inputs = {"orders": orders} if name == "confsib" else {"customer": customer}
            rows = conform(spark.sql(sql, **inputs), schema)
            rows.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{folder}/{name}")
        _LOADED[key] = read_tables(spark, folder, AS_OF, AS_OF_TS)
    return _LOADED[key]


_LOADED: dict[tuple[str, str], Reconciliation] = {}

# Error rows of ``events`` become errors of rejected records, four event ids to a record.
CODES = (*ERROR_CODES, "9999")


def load_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected records in the shape ``read_rejections`` gives, from the events table."""
    return shape_rejections(rejection_records(spark, sf_dir), "record")


def rejection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record`` and the attributes and elements of a rejected record.

    A record is at most four events, so its arrays are bounded.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'error'")
    number = F.get_json_object("props", "$.k").cast("int")
    codes = F.array(*[F.lit(code) for code in CODES])
    errors = events.select(
        F.floor(F.col("event_id") / 4).cast("long").alias("record"),
        F.struct(
            "event_id", "user_id", number.cast("string").alias("value"),
            F.get(codes, number % len(CODES)).alias("code"),
        ).alias("e"),
    )
    grouped = errors.groupBy("record").agg(F.sort_array(F.collect_list("e")).alias("es"))
    fields = F.transform("es", lambda e: F.struct(
        (e["event_id"] % 7).cast("string").alias("codigoCampo"),
        F.lit("campo").alias("descricaoCampo"),
        e["value"].alias("valorCampo"),
        F.array(F.struct(
            e["code"].alias("codigoErro"), F.lit("rejeitado").alias("mensagemErro")
        )).alias("erro"),
    ))
    kind = F.col("record") % 5
    names = F.array(*[F.lit(n) for n in ("", "INCLUSAO", "ALTERACAO", "EXCLUSAO", " REATIVACAO")])
    return grouped.select(
        "record",
        F.lpad((F.col("es")[0]["user_id"] + 1).cast("string"), 12, "0").alias("_cco"),
        F.col("record").cast("string").alias("_codigoBeneficiario"),
        kind.cast("string").alias("_codigoTipoMovimento"),
        F.get(names, kind.cast("int")).alias("_tipoMovimento"),
        fields.alias("campoErro"),
    )


def included_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record``, code, CCO and name of included records: one for every purchase."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'purchase'")
    return events.select(
        F.floor(F.col("event_id") / 4).cast("long").alias("record"),
        F.col("event_id").cast("string").alias("_codigoBeneficiario"),
        F.lpad((F.col("user_id") + 1).cast("string"), 12, "0").alias("cco"),
        F.concat(F.lit("PESSOA "), F.col("user_id").cast("string")).alias("nomeBeneficiario"),
    )


def _lines(records: DataFrame, tag: str, part: int, per_file: int) -> DataFrame:
    body = F.to_xml(F.struct(*[c for c in records.columns if c != "record"]), {"rowTag": tag})
    return records.select(_file(per_file).alias("file"), F.lit(part).alias("part"), body.alias("value"))


def _file(per_file: int):
    return F.floor(F.col("record") / per_file).cast("long")


def _totals(records: DataFrame, included: DataFrame, per_file: int) -> DataFrame:
    """``file, errors, movements``: the consolidated block of each file, as text."""
    file = _file(per_file).alias("file")
    counted = records.select(file, F.explode("campoErro").alias("f")).select("file", F.explode("f.erro").alias("e"))
    counted = counted.groupBy("file", "e.codigoErro", "e.mensagemErro").agg(F.count(F.lit(1)).alias("quantidadeOcorrenciaErro"))
    # A file has as many kinds of errors and movements as there are codes.
    errors = counted.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(
        "codigoErro", "mensagemErro", "quantidadeOcorrenciaErro"))).alias("erro"))
    errors = errors.select("file", F.to_xml(F.struct("erro"), {"rowTag": "consolidadoErroProcessamento"}).alias("errors"))
    name = F.concat(F.lit("consolidado"), F.initcap(F.trim("_tipoMovimento")))
    rejected = records.select(file, name.alias("name"), F.lit(1).alias("r"), F.lit(0).alias("ok"))
    accepted = included.select(file, F.lit("consolidadoInclusao").alias("name"), F.lit(0).alias("r"), F.lit(1).alias("ok"))
    moves = rejected.unionByName(accepted)
    moves = moves.unionByName(moves.withColumn("name", F.lit("consolidadoTotal"))).groupBy("file", "name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"), F.sum("r").alias("r"))
    entry = F.format_string(
        "<%s><quantidadeRegistros>%d</quantidadeRegistros><quantidadeProcessados>%d</quantidadeProcessados>"
        "<quantidadeRejeitados>%d</quantidadeRejeitados><percentualAcerto>%.2f</percentualAcerto></%s>",
        "name", "n", "ok", "r", (F.col("ok") * 100 / F.col("n")).alias("share"), "name",
    )
    movements = moves.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("movements"))
    return errors.join(movements, "file", "full_outer")


def write_rejection_files(
    records: DataFrame, folder: str, per_file: int = 100_000, included: DataFrame | None = None
) -> None:
    """The records as XML files of some ``per_file`` record numbers each; every fourth file is of
    another type. As many tasks as files write them, so the work spreads with the rows.

    With ``included`` records, files also hold these, a header, a protocol and the
    consolidated block.
    """
    kind = F.when(F.col("file") % 4 == 3, F.lit("ENVIO")).otherwise(F.lit("RESULTADO"))
    number = F.col("file").cast("string")
    every = records.select(_file(per_file).alias("file"))
    if included is not None:
        every = every.unionByName(included.select(_file(per_file).alias("file")))
    ends = every.distinct()
    start = F.concat(
        F.lit("<mensagemSIB><cabecalho><identificacaoTransacao><tipoTransacao>"), kind,
        F.lit("</tipoTransacao><sequencialTransacao>"), number,
        F.lit("</sequencialTransacao><dataHoraRegistroTransacao>2001-10-31T12:00:00</dataHoraRegistroTransacao>"
              "</identificacaoTransacao><origem><cnpj>00000000000191</cnpj></origem><destino><registroANS>123456</registroANS>"
              "</destino><versaoPadrao>1.1</versaoPadrao></cabecalho><mensagem><arquivoProcessado><protocoloProcessamento>"
              "<numeroProtocolo>P"), number, F.lit("</numeroProtocolo><nomeArquivo>F"), number,
        F.lit(".SBX</nomeArquivo></protocoloProcessamento><registrosRejeitados>"),
    )
    between = F.lit("</registrosRejeitados><registrosIncluidos>")
    close = F.concat(
        F.lit("</registrosRejeitados>" if included is None else "</registrosIncluidos><consolidado>"),
        F.coalesce("errors", F.lit("")),
        F.concat(F.lit("<consolidadoProcessamento>"), "movements", F.lit("</consolidadoProcessamento></consolidado>"))
        if included is not None else F.lit(""),
        F.lit("</arquivoProcessado></mensagem><epilogo><hash>H"), number, F.lit("</hash></epilogo></mensagemSIB>"),
    )
    lines = _lines(records, "registroRejeitado", 1, per_file)
    texts = [(ends, 0, start)]
    nothing = F.lit(None).cast("string")
    if included is None:
        texts.append((ends.withColumns({"errors": nothing, "movements": nothing}), 4, close))
    else:
        lines = lines.unionByName(_lines(included, "registroIncluido", 3, per_file))
        texts += [(ends, 2, between), (_totals(records, included, per_file), 4, close)]
    for rows, part, text in texts:
        lines = lines.unionByName(rows.select("file", F.lit(part).alias("part"), text.alias("value")))
    ordered = lines.repartition("file").sortWithinPartitions("file", "part")
    ordered.select("file", "value").write.partitionBy("file").text(folder)
