"""Read rejection files (XML) of a file or a whole folder, in parallel, one schema each.

Files are read as text that is cut where a record ends, so a file larger than a split is
read by several tasks; each piece holds one record at most beside self-closing ones. Only
rows of valid files are given: the root is a message, its type (if given) is a processing
result, and it has a processed block. ``arquivo`` names the file a row came from. Record
tags inside comments or character data are not expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from concilia import schemas
from concilia.functions.text import trimmed
from concilia.operators.rejections import flatten, suggest

ENCODING = "ISO-8859-1"
FILES = "*.{RPX,rpx,XML,xml}"
#: Both kinds of record, and the lists of them, end with this.
RECORD_END = "</registro"
REJECTED, INCLUDED = "registroRejeitado", "registroIncluido"


def piece_reader(reader, files: str = FILES):
    """Options shared by batch and stream; ``reader`` is ``spark.read`` or ``readStream``."""
    return reader.format("text").option("lineSep", RECORD_END).option("pathGlobFilter", files)


def pieces(raw: DataFrame, encoding: str = ENCODING) -> DataFrame:
    """``arquivo, piece``: the text between two record ends, decoded."""
    text = F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.col("_metadata.file_path").alias("arquivo"), text.alias("piece"))


def _pieces(spark: SparkSession, path: str, encoding: str, files: str) -> DataFrame:
    return pieces(piece_reader(spark.read, files).load(path), encoding)


def _text(path: str, name: str):
    return F.expr(trimmed(path)).alias(name)


def _element(tag: str) -> Column:
    """The element with that tag as text, NULL where the piece has none whole."""
    return F.nullif(F.regexp_extract("piece", rf"(?s)<{tag}\b.*</{tag}>", 0), F.lit(""))


def _records(rows: DataFrame, tag: str, schema: T.StructType) -> DataFrame:
    """``arquivo`` and the records of a tag. A piece's last record was cut before its end."""
    parts = F.split("piece", rf"<{tag}(?=[\s/>])")
    bodies = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    closed = r'^(?:[^>"\']|"[^"]*"|\'[^\']*\')*?/>'
    whole = F.transform(bodies, lambda body: F.concat(F.lit(f"<{tag}"), F.when(
        body.rlike(closed), F.regexp_extract(body, closed, 0)
    ).otherwise(F.concat(body, F.lit(f"</{tag}>")))))
    found = rows.filter(F.contains("piece", F.lit(f"<{tag}"))).select(
        "arquivo", F.explode(whole).alias("xml")
    )
    return found.select("arquivo", F.from_xml("xml", schema).alias("r")).select("arquivo", "r.*")


def shape_rejections(raw: DataFrame, *keep: str) -> DataFrame:
    """Plain names for the attributes, and the flattened errors."""
    named = raw.select(
        *keep,
        _text("_cco", "cco"),
        _text("_codigoBeneficiario", "codigo_beneficiario"),
        _text("_codigoTipoMovimento", "codigo_tipo_movimento"),
        _text("_tipoMovimento", "tipo_movimento"),
        "campoErro",
    )
    return flatten(named)


def file_headers(rows: DataFrame) -> DataFrame:
    """Header and protocol of every valid file among the pieces; one row per file."""
    root = r"^\ufeff?\s*(?:<\?[^>]*\?>\s*)?(?:<!--(?s:.*?)-->\s*)*<mensagemSIB\b"
    marks = rows.filter(F.col("piece").rlike(
        r"<mensagemSIB|<cabecalho|<arquivoProcessado|<protocoloProcessamento|<epilogo|\AANS>"
    ))
    # A header that names a registroANS is cut there, as if a record ended: put together again.
    part = lambda pattern: F.nullif(F.regexp_extract("piece", pattern, 0), F.lit(""))
    begin = part(r"(?s)<cabecalho\b(?!.*</cabecalho>).*\z")
    middle = F.when(F.col("piece").startswith("ANS>") & ~F.contains("piece", F.lit("</cabecalho>")), F.col("piece"))
    rest = part(r"(?s)\AANS>(?:(?!<cabecalho\b).)*?</cabecalho>")
    facts = marks.groupBy("arquivo").agg(
        F.bool_or(F.col("piece").rlike(root)).alias("message"),
        F.bool_or(F.col("piece").rlike(r"<arquivoProcessado\b")).alias("processed"),
        F.coalesce(
            F.max(_element("cabecalho")), F.concat_ws(RECORD_END, F.max(begin), F.max(middle), F.max(rest))
        ).alias("top"),
        F.max(_element("protocoloProcessamento")).alias("protocol"),
        F.max(_element("epilogo")).alias("end"),
    )
    head = T.StructType([f for f in schemas.HEADER_XML["cabecalho"].dataType])
    protocol = T.StructType([f for f in schemas.PROTOCOL_XML["protocoloProcessamento"].dataType])
    read = facts.filter("message and processed").select(
        "arquivo",
        F.from_xml("top", head).alias("cabecalho"),
        F.from_xml("protocol", protocol).alias("protocoloProcessamento"),
        F.from_xml("end", schemas.HEADER_XML["epilogo"].dataType).alias("epilogo"),
    ).select(
        "arquivo",
        _text("cabecalho.identificacaoTransacao.tipoTransacao", "tipo_transacao"),
        _text("cabecalho.identificacaoTransacao.sequencialTransacao", "sequencial"),
        _text("cabecalho.identificacaoTransacao.dataHoraRegistroTransacao", "data_hora"),
        _text("cabecalho.origem.cnpj", "cnpj_origem"),
        _text("cabecalho.destino.registroANS", "registro_ans"),
        _text("cabecalho.versaoPadrao", "versao_padrao"),
        _text("epilogo.hash", "hash"),
        _text("protocoloProcessamento.numeroProtocolo", "numero_protocolo"),
        _text("protocoloProcessamento.nomeArquivo", "nome_arquivo"),
    )
    kind = F.coalesce("tipo_transacao", F.lit(""))
    return read.filter((kind == "") | F.upper(kind).contains("RESULTADO"))


def of_valid_files(rows: DataFrame) -> DataFrame:
    return rows.join(file_headers(rows).select("arquivo"), "arquivo", "left_semi")


def rejections_in(rows: DataFrame) -> DataFrame:
    """Rejected records of the valid files among the pieces."""
    return shape_rejections(_records(of_valid_files(rows), REJECTED, schemas.REJECTED_XML), "arquivo")


def read_rejections(
    spark: SparkSession, path: str, encoding: str = ENCODING, files: str = FILES
) -> DataFrame:
    return rejections_in(_pieces(spark, path, encoding, files))


def read_inclusions(
    spark: SparkSession, path: str, encoding: str = ENCODING, files: str = FILES
) -> DataFrame:
    rows = of_valid_files(_pieces(spark, path, encoding, files))
    return _records(rows, INCLUDED, schemas.INCLUDED_XML).select(
        "arquivo", _text("_codigoBeneficiario", "codigo_beneficiario"), _text("cco", "cco"),
        _text("nomeBeneficiario", "nome_beneficiario"),
    )


def read_file_headers(
    spark: SparkSession, path: str, encoding: str = ENCODING, files: str = FILES
) -> DataFrame:
    """Header and protocol of every valid file. Others are in ``invalid_files``."""
    return file_headers(_pieces(spark, path, encoding, files))


def invalid_files(
    spark: SparkSession, path: str, encoding: str = ENCODING, files: str = FILES
) -> DataFrame:
    """Files of the folder that are not valid results, kept apart instead of failing the job."""
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", files).load(path)
        .select(F.col("_metadata.file_path").alias("arquivo"))
    )
    valid = read_file_headers(spark, path, encoding, files).select("arquivo")
    return listed.join(valid, "arquivo", "left_anti")


def _consolidated(
    spark: SparkSession, path: str, schema: T.StructType, encoding: str, files: str
) -> DataFrame:
    rows = of_valid_files(_pieces(spark, path, encoding, files))
    block = rows.select("arquivo", _element("consolidado").alias("xml")).filter("xml is not null")
    return block.select("arquivo", F.from_xml("xml", schema).alias("r")).select("arquivo", "r.*")


def read_error_totals(
    spark: SparkSession, path: str, encoding: str = ENCODING, files: str = FILES
) -> DataFrame:
    """Errors with their quantity from the consolidated block, explained."""
    raw = _consolidated(spark, path, schemas.ERROR_TOTAL_XML, encoding, files)
    rows = raw.select("arquivo", F.explode("consolidadoErroProcessamento.erro").alias("e")).select(
        "arquivo",
        _text("e.codigoErro", "codigo_erro"),
        _text("e.mensagemErro", "mensagem_erro"),
        F.expr("coalesce(try_cast(trim(e.quantidadeOcorrenciaErro) as int), 0)").alias(
            "quantidade"),
    )
    return suggest(rows).orderBy("arquivo", F.col("quantidade").desc(), "codigo_erro")


def read_movement_totals(
    spark: SparkSession, path: str, encoding: str = ENCODING, files: str = FILES
) -> DataFrame:
    """One row per movement of the consolidated block; the row ``Total`` is the file's total.

    The element names are data (one per movement), so the block is read as a map.
    """
    counts = T.StructType([
        T.StructField(n, T.StringType())
        for n in ("quantidadeRegistros", "quantidadeProcessados", "quantidadeRejeitados",
                  "percentualAcerto")
    ])
    schema = T.StructType([
        T.StructField("consolidadoProcessamento", T.MapType(T.StringType(), counts)),
    ])
    raw = _consolidated(spark, path, schema, encoding, files)
    rows = raw.select("arquivo", F.explode("consolidadoProcessamento").alias("name", "n"))

    def number(name: str, kind: str):
        return F.expr(f"coalesce(try_cast(trim(n.{name}) as {kind}), 0)")

    return rows.select(
        "arquivo",
        F.replace(F.col("name"), F.lit("consolidado"), F.lit("")).alias("tipo"),
        number("quantidadeRegistros", "int").alias("quantidade_registros"),
        number("quantidadeProcessados", "int").alias("quantidade_processados"),
        number("quantidadeRejeitados", "int").alias("quantidade_rejeitados"),
        number("percentualAcerto", "double").alias("percentual_acerto"),
    )
