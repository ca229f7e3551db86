"""Values the data and its users agree on.

Everything in this module is a fixed value: codes, labels and column names that
appear in the tables or in the results and must be spelled exactly like this.
"""

# --- fixed values: movement codes (column ``posans``) -----------------------
INCLUSION = "1-INCLUSAO"
CHANGE = "2-ALTERACAO"
EXCLUSION = "3-EXCLUSAO"
UPDATED = "4-ATUALIZADO"
REINCLUSION = "8-REINCLUSAO"
REACTIVATION = "9-RET REATIV"
FLEX = "10-SIB-FLEX"
MOVEMENTS = (INCLUSION, CHANGE, EXCLUSION, UPDATED, REINCLUSION, REACTIVATION, FLEX)

# --- fixed values: member situation, registry status, severity --------------
ACTIVE = "ATIVO"
INACTIVE = "INATIVO"
REG_ACTIVE = "A"
REG_INACTIVE = "I"
SEVERITIES = ("critica", "alta", "media", "baixa")
HOLDER = "00"

# --- fixed values: the twelve "send this field" flags of a member -----------
FLAGS = (
    "ansrg", "anscpf", "ansmae", "anscns", "ansnasc", "ansparentesco",
    "anstitular", "ansnome", "ansplano", "ansdataini", "ansdatafim", "anscnpjcei",
)

# --- fixed values: column lists of the results ------------------------------
MEMBER_COLUMNS = (
    "id", "codtit", "codusu", "nomeusu", "situusu", "posans", "codcco", "codans",
    "cpfusu", "nascusu", "sexousu", "dataini", "datafim", "dataexc", "datareinc",
    "dataalt", "mae", "cns", "codplano", "codplaport", "parentesco", "datacad",
)
MATCH_COLUMNS = (
    "id", "codtit", "codusu", "nomeusu", "situusu", "posans", "codcco", "codans",
    "cpfusu", "nascusu", "dataini", "datafim",
)
REGISTRY_COLUMNS = (
    "numseq", "status", "codcco", "codusu", "nomeusu", "cpfusu", "nascusu",
    "sexousu", "dataini", "datafim", "flag", "registro",
)

# --- fixed values: ledger states --------------------------------------------
WAITING = "aguardando"
RESOLVED = "resolvido"
EXPIRED = "expirado"
WAIT_DAYS = 45

# --- fixed values: texts found in result columns ----------------------------
KEY_CCO_COMPATIBLE = "CODCCO (+ compat. CPF/nome/nasc)"
KEY_CODE_BIRTH = "CODANS=CODUSU + nascimento"
KEY_CPF_BIRTH = "CPF + nascimento"
KEY_EXACT = "CCO + nome + CPF + nascimento + dataini"
KEY_FULL_CCO = "validacao completa (CCO)"
KEY_FULL_NO_CCO = "validacao completa (sem CCO local)"
TODO_REINCLUSION = "pendente de reinclusao"
TODO_UPDATED = "posans -> 4-ATUALIZADO"
TODO_LINK = "vincular CCO + 4-ATUALIZADO"
HINT_INACTIVE = "confsib ja inativa -> 4-ATUALIZADO"
HINT_ACTIVE = "confsib ativa -> 3-EXCLUSAO"
HINT_MISSING = "sem confsib -> 3-EXCLUSAO"
NOTE_EXCLUSION = "CCO ja inativo na ANS - nao reenviar 3-EXCLUSAO"
NOTE_REACTIVATION = "CCO ja ativo na ANS - nao enviar reativacao/reinclusao"
NOTE_SAME_PERSON = "mesma pessoa - vincular CCO + 4-ATUALIZADO"
NAME_SEND = "enviar nome local a ANS (RF humano, SIB-FLEX)"
NAME_ALIGN = "alinhar nometit ao nome local (titular)"
NAME_OK = "ok"
HOLDER_UPDATE = "atualizar nometit com nomeusu local"
HOLDER_OK = "titular - nometit ok"
FLEX_NO_REGISTRY = "sem confsib"
FLEX_DIFFERS = "com divergência"
FLEX_EQUAL = "sem divergência detectável"
NAME_DIGIT = "nomeusu com digito"
NAME_CHARACTER = "nomeusu com caractere invalido"
MOTHER_DIGIT = "mae com digito"
MOTHER_CHARACTER = "mae com caractere invalido"
MOTHER_ONE_WORD = "mae sem sobrenome"
NO_DATE = "(sem data)"
REASON_FULL = "validacao completa"
REASON_FULL_LINK = "validacao completa - vincular CCO"
CODE_FROM_REGISTRY = "confsib"
CODE_COMPOSED = "montado"
