"""Explicit input schemas. Empty inputs keep their columns."""

from pyspark.sql import types as T

from concilia.vocabulary import FLAGS


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, kind, True) for name in names]


_TEXT, _DAY, _LONG, _TIME = T.StringType(), T.DateType(), T.LongType(), T.TimestampType()

MEMBERS = T.StructType(
    [T.StructField("id", _LONG, False)]
    + _fields(
        _TEXT, "codtit", "codusu", "nomeusu", "mae", "situusu", "posans", "codcco",
        "codans", "cpfusu", "cns", "rgusu", "sexousu", "codplano", "codplaport", "parentesco",
    )
    + _fields(_DAY, "nascusu", "dataini", "datafim", "dataexc", "datareinc", "dataalt", "datacad")
    + _fields(_TEXT, *FLAGS)
    + _fields(_DAY, "dataultalt")
    + _fields(_TIME, "dtope")
)

# The registry keeps its dates as text, in two formats.
REGISTRY = T.StructType(
    _fields(_LONG, "numseq")
    + _fields(
        _TEXT, "status", "codcco", "codusu", "codtit", "nomeusu", "cpfusu", "cns",
        "sexousu", "mae", "parentesco", "docident", "nascusu", "dataini", "datafim",
        "codplaport", "codplaope", "cnpj", "flag", "registro",
    )
)

CONTRACTS = T.StructType(_fields(_TEXT, "codtit", "nometit") + _fields(_TIME, "dtope"))

LEDGER = T.StructType(
    _fields(_LONG, "cadusu_id")
    + _fields(_TEXT, "rule_id", "codcco", "posans_aplicado", "status")
    + _fields(_TIME, "applied_at", "wait_until", "resolved_at")
    + _fields(_TEXT, "note")
    + _fields(_LONG, "baseline_numseq")
)

# Rejection files (XML). Attributes arrive with a leading underscore.
_ERROR = T.StructType(_fields(_TEXT, "codigoErro", "mensagemErro"))
_FIELD = T.StructType(
    _fields(_TEXT, "codigoCampo", "descricaoCampo", "valorCampo")
    + [T.StructField("erro", T.ArrayType(_ERROR), True)]
)
REJECTED_XML = T.StructType(
    _fields(_TEXT, "_cco", "_codigoBeneficiario", "_codigoTipoMovimento", "_tipoMovimento")
    + [T.StructField("campoErro", T.ArrayType(_FIELD), True)]
)
INCLUDED_XML = T.StructType(_fields(_TEXT, "_codigoBeneficiario", "cco", "nomeBeneficiario"))


def _group(name: str, *children: T.StructField) -> T.StructField:
    return T.StructField(name, T.StructType(list(children)), True)


HEADER_XML = T.StructType([
    _group(
        "cabecalho",
        _group("identificacaoTransacao", *_fields(
            _TEXT, "tipoTransacao", "sequencialTransacao", "dataHoraRegistroTransacao")),
        _group("origem", *_fields(_TEXT, "cnpj")),
        _group("destino", *_fields(_TEXT, "registroANS")),
        *_fields(_TEXT, "versaoPadrao"),
    ),
    _group("epilogo", *_fields(_TEXT, "hash")),
])
PROTOCOL_XML = T.StructType([
    _group("protocoloProcessamento", *_fields(_TEXT, "numeroProtocolo", "nomeArquivo")),
])
ERROR_TOTAL_XML = T.StructType([
    _group("consolidadoErroProcessamento", T.StructField(
        "erro",
        T.ArrayType(T.StructType(
            _fields(_TEXT, "codigoErro", "mensagemErro", "quantidadeOcorrenciaErro"))),
        True,
    )),
])
