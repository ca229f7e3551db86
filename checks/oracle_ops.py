"""SQL for the second engine: operators other than rules and corrections."""

from __future__ import annotations

from checks.oracle_rules import (
    ALL, COMPATIBLE, DAY, FIX, FLAGS, FROM, LATE, NOT_FOUND, NOW, ORPHAN, PRELUDE, cols,
    fix_sql, hits_sql, parsed, rule_sql, waiting,
)
from concilia.plans.catalogue import RULES
from concilia.plans.corrections import metadata
from concilia.sources.derived import CODES
from concilia.operators.rejections import BY_HAND, ERROR_CODES

R12, R14 = "inativo_cadusu_ativo_confsib", "ativo_inativo_confsib_reinclusao"
SQL: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _p(body: str) -> str:
    return f"{PRELUDE} {body}"


def _iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


# -- sources and scalar functions ---

SQL["src_members"] = _p(
    f"select {cols(ALL + ' ' + ' '.join(FLAGS))}, nullif(cco_, '') as m_cco,"
    " nullif(cpf_, '') as m_cpf, dig_ as m_digits, name_ as m_name from m"
)
SQL["src_registry"] = _p(
    "select cast(numseq as varchar) as r_numseq, st_ as r_state, codcco as r_codcco,"
    " nullif(cco_, '') as r_cco, codusu as r_codusu, name_ as r_name,"
    " cast(born as varchar) as r_birth, cast(begun as varchar) as r_start,"
    " cast(ended as varchar) as r_end from r"
)
SQL["fn_parse_date"] = _p(
    "select cast(numseq as varchar) as numseq, nascusu, dataini, cast(born as varchar) as birth,"
    " cast(begun as varchar) as start from r"
)
SQL["fn_text"] = _p(
    "select id, cco_ = '' as blank, dig_ as digits,"
    " upper(regexp_replace(rgusu, '[^0-9A-Za-z]', '', 'g')) as document,"
    " left(codtit, 4) as company, left(codtit || '-' || codusu, 30) as code,"
    " left(trim(nomeusu, ' '), 10) as short, case when code_ <> '' then code_ else cns_ end as"
    " \"first\", upper(mae_) as mother, len(regexp_split_to_array(mae_, '\\s+')) as words from m"
)
SQL["fn_dates"] = _p(
    f"select id, {LATE} as late, coalesce(m.dataini < {DAY} - 90, false) as old,"
    " coalesce(strftime(nascusu, '%d/%m/%Y'), '(sem data)') as birth from m"
)
SQL["dq_unparsed_dates"] = _p(
    "select field, count(*) as total from (" + " union all ".join(
        f"select '{f}' as field from r where trim(coalesce({f}, ''), ' ') <> '' and"
        f" ({parsed(f)}) is null" for f in ("nascusu", "dataini", "datafim")
    ) + ") group by field"
)
SQL["sink_json_rows"] = _p(
    "select cast(to_json({'id': m.id, 'codtit': m.codtit, 'nomeusu': m.nomeusu, 'dataini':"
    " cast(m.dataini as varchar), 'datafim': cast(m.datafim as varchar), 'nome_ans': s.nomeusu})"
    f" as varchar) as row {FROM['exclusao_cco_ja_inativo_confsib']}"
)

# -- joins ---

_LATEST = "m.id, s.status as r_status, s.nomeusu as r_nomeusu, s.dataini as r_dataini"
SQL["join_latest_inner"] = SQL["join_bucketed_layout"] = _p(
    f"select {_LATEST} from m, lateral (select * from r where r.codcco = m.codcco"
    " order by r.numseq desc nulls first limit 1) s"
)
SQL["join_latest_left"] = _p(f"select {_LATEST} from m left join raw1 s on s.codcco = m.codcco")
SQL["join_lateral_top1"] = (
    f"select c_custkey, c_name, o_orderkey, {_iso('o_orderdate')} as o_orderdate from customer"
    " join orders on o_custkey = c_custkey where o_orderstatus = 'F' qualify row_number() over"
    " (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey) = 1"
)


def _tiers(situation: str, status: str) -> str:
    shown = (
        "m.id, m.situusu, s.status as status_ans, s.codcco as cco_ans, s.codusu as codusu_ans,"
        " s.nascusu as nasc_ans"
    )
    by_code = "(m.code_ <> '' and s.codusu = m.codans and s.born = m.nascusu)"
    by_cpf = "(m.cpf_ <> '' and s.cpfusu = m.cpfusu and s.born = m.nascusu)"
    return (
        f"(select {shown}, 'CODCCO (+ compat. CPF/nome/nasc)' as chave_usada from m join raw1 s"
        f" on s.codcco = m.codcco where m.cco_ <> '' and m.situusu = '{situation}'"
        f" and s.st_ = '{status}' and {COMPATIBLE} union all select {shown},"
        " case when m.code_ <> '' and s.codusu = m.codans then 'CODANS=CODUSU + nascimento'"
        f" else 'CPF + nascimento' end from m join r s on {by_code} or {by_cpf}"
        f" where m.cco_ = '' and m.situusu = '{situation}' and s.st_ = '{status}'"
        " qualify row_number() over (partition by m.id order by s.numseq desc nulls first) = 1)"
    )


SQL["match_tiered"] = _p(f"{_tiers('ATIVO', 'I')} union all {_tiers('INATIVO', 'A')}")
SQL["anti_member_missing"] = _p(f"select id, codcco from m where {NOT_FOUND}")
SQL["anti_registry_orphan"] = _p(
    "select cast(numseq as varchar) as r_numseq, codcco as r_codcco, codusu as r_codusu from r s"
    f" where {ORPHAN}"
)
SQL["semi_status"] = _p(
    "select id, codcco from m where exists (select 1 from r where r.codcco = m.codcco and st_ = 'I')"
)
SQL["join_any_version"] = _p(
    "select m.id, m.nomeusu, s.nomeusu as nome_ans from m join r s on s.codcco = m.codcco"
    " where s.name_ <> '' and s.name_ <> m.name_ qualify row_number() over (partition by m.id"
    " order by s.numseq desc nulls first) = 1"
)
SQL["join_identity"] = _p(
    "select m.id, cast(s.numseq as varchar) as r_numseq, s.codcco as r_codcco, s.cpfusu as r_cpfusu"
    " from m join r s on m.name_ <> '' and s.name_ = m.name_ and s.born = m.nascusu and s.begun ="
    " m.dataini and s.dig_ = m.dig_ qualify row_number() over (partition by m.id order by s.numseq"
    " desc nulls first) = 1"
)
_CHOSEN = "(select user_id + 1 from events where event_type = 'purchase')"
SQL["sel_semi"] = _p(f"select id, nomeusu, posans from m where id in {_CHOSEN}")
SQL["pending_exclude"] = _p(
    f"select id, posans from m where situusu = 'INATIVO' and not {waiting(R12)}"
)

# -- aggregations ---

_RULE_VALUES = "(values " + ", ".join(
    f"({_q(r.id)}, {_q(r.severity)}, {_q(r.category)}, {_q(r.title)},"
    f" {str(metadata(r.id)['fixable']).lower()}, {_q(metadata(r.id)['fix_fields'])})"
    for r in RULES
) + ") k(rule_id, severity, category, title, fixable, fix_fields)"
_TOTALS = (
    f"(select k.*, coalesce(h.n, 0) as total from {_RULE_VALUES} left join (select rule_id,"
    f" count(*) as n from ({hits_sql()}) group by rule_id) h on h.rule_id = k.rule_id)"
)
SQL["agg_rule_count"] = _p(
    f"select rule_id, count(*) as total from ({hits_sql()}) where rule_id in ('cco_duplicado',"
    " 'ativo_cadusu_inativo_confsib', 'confsib_sem_cadusu') group by rule_id"
)
SQL["agg_rule_summary"] = _p(f"select rule_id, severity, total, total = 0 as ok from {_TOTALS}")
SQL["agg_summary_meta"] = _p(
    "select count(*) as rules, count(*) filter (where total > 0) as rules_with_hits,"
    f" cast(sum(total) as bigint) as hits from {_TOTALS}"
)
SQL["agg_dashboard"] = _p(
    "select (select count(*) from m) as cadusu, (select count(*) from r) as confsib,"
    " (select count(*) from m where situusu = 'ATIVO') as ativos,"
    " (select count(*) from m where situusu = 'INATIVO') as inativos"
)
SQL["agg_dup_keys"] = _p(
    "select cco_ as m_cco, count(*) as n from m where cco_ <> '' group by cco_ having count(*) > 1"
)
_BASE = (
    "(select *, left(codtit, 4) as empresa, cpf_ as cpf from m where situusu = 'ATIVO' and"
    " regexp_full_match(cpfusu, '[0-9]{11}') and length(codtit) >= 4)"
)
_RANGE = (
    "count(*) as n, cast(min(nascusu) as varchar) as least, cast(max(nascusu) as varchar) as"
    " greatest, count(*) filter (where nascusu is null) as unknown"
)
SQL["agg_mixed_groups"] = _p(
    f"select empresa, cpf, {_RANGE} from {_BASE} group by empresa, cpf having count(*) > 1 and"
    " count(distinct coalesce(cast(nascusu as varchar), '-')) > 1"
)
SQL["agg_distinct"] = _p(
    "select st_ as r_state, count(distinct nullif(cco_, '')) as ccos from r group by st_"
)
SQL["agg_listagg"] = _p(
    "select left(codtit, 4) as b_empresa, cpf_ as b_cpf, string_agg(distinct"
    " coalesce(strftime(nascusu, '%d/%m/%Y'), '(sem data)'), ' | ' order by"
    " coalesce(strftime(nascusu, '%d/%m/%Y'), '(sem data)')) as nascimentos_do_cpf from m"
    " where situusu = 'ATIVO' and cpf_ <> '' and length(codtit) >= 4 group by all"
)
SQL["agg_hwm"] = _p("select max(numseq) as max_numseq from r")

# -- windows, order, limits, sets ---

SQL["win_latest"] = _p(
    "select cco_ as r_cco, cast(numseq as varchar) as r_numseq, st_ as r_state from trim1"
)
SQL["win_first_per_member"] = (
    "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition"
    " by o_custkey order by o_totalprice desc nulls last, o_orderkey) = 1"
)
SQL["win_keeper"] = _p(
    f"select empresa as g_empresa, cpf as g_cpf, id as id_mantido from {_BASE} qualify row_number()"
    " over (partition by empresa, cpf order by nascusu asc nulls last, case when codusu = '00' then"
    " 0 else 1 end, id) = 1"
)
SQL["win_group_stats"] = _p(
    f"select empresa as g_empresa, cpf as g_cpf, {_RANGE} from {_BASE} group by empresa, cpf"
    " having count(*) > 1"
)
SQL["sort_detail"] = _p(
    f"select {cols('id dataalt dataini codtit codusu')} {FROM['alteracao_com_cco']} order by"
    " m.dataalt asc nulls last, m.dataini asc nulls last, m.codtit, m.codusu, m.id"
)
SQL["sort_critical"] = _p(
    f"select {cols('id dataini codtit codusu')} {FROM['inativo_sem_cco_nao_atualizado']} order by"
    " m.dataini desc nulls last, m.codtit, m.codusu, m.id"
)
SQL["sort_rules"] = _p(
    f"select rule_id, title, total from {_TOTALS} order by total desc, title"
)
SQL["filter_rules"] = _p(
    f"select rule_id, total from {_TOTALS} where severity = 'alta' and total > 0"
)
SQL["limit_truncated"] = _p(
    "select count(*) as total, least(count(*), 500) as returned, count(*) > 500 as truncated"
    f" from (select 1 {FROM['confsib_sem_cadusu']})"
)
_THREE = ("inativo_sem_cco_nao_atualizado", "inativo_cco_null_exclusao", "cadusu_sem_codans")
SQL["set_union_ids"] = _p(" union ".join(f"(select id {FROM[x]})" for x in _THREE))
SQL["set_union_all"] = _p(
    " union all ".join(f"(select id, '{x}' as rule_id {FROM[x]})" for x in _THREE)
)
SQL["set_norm_keys"] = _p("select distinct cco_ as codcco from r where cco_ <> ''")

# -- catalogue and corrections ---

SQL["rule_catalog"] = _p(
    f"select rule_id, severity, category, title, fixable, fix_fields, total from {_TOTALS}"
)
_MEMBER_HITS = " union all ".join(
    f"(select '{x}' as rule_id, m.id as id {source})"
    for x, source in FROM.items() if not x.startswith("confsib_sem")
)
SQL["rule_scan"] = SQL["rule_scan_incremental"] = _p(
    f"select id, string_agg(rule_id, ',' order by rule_id) as rules from ({_MEMBER_HITS})"
    " group by id"
)


def _changes() -> str:
    """What the statements that apply each plan change, row by row."""
    from concilia.plans.corrections import PLANS

    parts = []
    for plan in PLANS:
        shown = plan.shown or {}
        for field in plan.assign:
            name = shown.get(field, field)
            parts.append(
                f"select '{plan.rule_id}' as rule_id, 'cadusu' as table_name, cast(id as varchar)"
                f" as key, '{field}' as field, cast({name}_atual as varchar) as old_value,"
                f" cast({name}_novo as varchar) as new_value from ({FIX[plan.rule_id]})"
                f" where {name}_atual is distinct from {name}_novo"
            )
    # The contract statement sets the name only where there is one and it differs.
    parts.append(
        "select distinct 'divergencia_nome_cadusu_confsib', 'cadcont', ct.codtit, 'nometit',"
        f" ct.nometit, f.new {_NEW_TITLES} where {_TITLE_CHANGES}"
    )
    return " union all ".join(parts)


_NEW_TITLES = (
    "from ct join (select codtit, min(nometit_novo) as new from"
    f" ({FIX['divergencia_nome_cadusu_confsib']}) where nometit_novo is not null group by codtit)"
    " f on f.codtit = ct.codtit"
)
_TITLE_CHANGES = (
    "f.new is not null and upper(trim(coalesce(ct.nometit, ''), ' ')) <> upper(f.new)"
)
SQL["fix_change_set"] = _p(f"select *, cast({DAY} as varchar) as as_of from ({_changes()})")
SQL["fix_conflicts"] = _p(
    "select table_name, key, field, count(distinct coalesce(new_value, chr(1))) as \"values\","
    f" count(distinct rule_id) as rules from ({_changes()}) group by table_name, key, field"
    " having count(distinct coalesce(new_value, chr(1))) > 1"
)


def _snapshot(rule_id: str, situusu: str, posans: str, codcco: str, datafim: str, extra="") -> str:
    hit = "f.id is not null"
    return _p(
        f"select m.id, {situusu} as situusu, case when {hit} then {posans} else m.posans end as"
        f" posans, {codcco} as codcco, {datafim} as datafim, case when {hit} then"
        f" cast({DAY} as varchar) end as dataultalt, case when {hit} then {_iso(NOW)} end as dtope"
        f" from m left join (select * from ({FIX[rule_id]}){extra}) f on f.id = m.id"
    )


SQL["fix_apply_snapshot"] = SQL["fix_apply_buckets"] = _snapshot(
    "reativacao_cco_ja_ativo_confsib",
    "case when f.id is not null then 'ATIVO' else m.situusu end", "'4-ATUALIZADO'", "m.codcco",
    "case when f.id is null then cast(m.datafim as varchar) end",
)
SQL["fix_apply_scan"] = _snapshot(
    "inativo_sem_cco_nao_atualizado", "m.situusu", "'4-ATUALIZADO'", "m.codcco",
    "cast(m.datafim as varchar)",
)
SQL["fix_apply_selected"] = _snapshot(
    "ativo_cadusu_inativo_confsib", "m.situusu", "'4-ATUALIZADO'",
    "case when f.id is not null then f.codcco_novo else m.codcco end",
    "cast(m.datafim as varchar)", f" where id in {_CHOSEN}",
)
SQL["fix_apply_counts"] = _p(
    f"select (select count(distinct user_id) from events where event_type = 'purchase') as"
    " requested, (select count(*) from m where id in (select id from"
    f" ({FIX['reativacao_cco_ja_ativo_confsib']})) and id in {_CHOSEN}) as updated"
)
SQL["fix_apply_contracts"] = _p(
    f"select ct.codtit, case when {_TITLE_CHANGES} then f.new else ct.nometit end as nometit,"
    f" case when {_TITLE_CHANGES} then {_iso(NOW)} else {_iso('ct.dtope')} end as dtope"
    f" {_NEW_TITLES.replace('from ct join', 'from ct left join')}"
)

# -- ledger ---


def _led(status: str, resolved: str, note: str, source: str) -> str:
    return (
        f"select cadusu_id, rule_id, codcco, posans_aplicado, {status} as status,"
        f" {_iso('applied_at')} as applied_at, {_iso('wait_until')} as wait_until, {resolved} as"
        f" resolved_at, {note} as note, cast(baseline_numseq as varchar) as baseline_numseq {source}"
    )


_ROW = ("status", _iso("resolved_at"), "note")
SQL["pending_register"] = _p(
    "select * exclude (note) from (" + _led(*_ROW, f"from led where rule_id <> '{R12}' or cadusu_id"
    f" not in (select id from ({FIX[R12]}))") + " union all "
    f"select f.id, '{R12}', trim(f.codcco, ' '), '3-EXCLUSAO', 'aguardando', {_iso(NOW)},"
    f" {_iso(NOW + ' + interval 45 day')}, cast(null as varchar), 'x',"
    f" cast(s.numseq as varchar) from ({FIX[R12]}) f left join trim1 s on"
    " s.cco_ = trim(f.codcco, ' '))"
)
_HIT = (
    f"l.status = 'aguardando' and s.numseq is not null and s.st_ = case when rule_id = '{R12}' then 'I'"
    " else 'A' end and (baseline_numseq is null or s.numseq > baseline_numseq)"
)


def _resolved(source: str) -> str:
    return (
        f"select l.*, coalesce({_HIT}, false) as hit, s.st_ as seen, s.numseq as seq"
        f" from ({source}) l left join trim1 s on s.cco_ = trim(l.codcco, ' ')"
    )


_NOTE = (
    "case when hit then 'auto: confsib status=' || seen || ' numseq=' || cast(seq as varchar) ||"
    " coalesce(' > baseline=' || cast(baseline_numseq as varchar), ' (sem baseline)') else note end"
)
SQL["pending_auto_resolve"] = _p(_led(
    "case when hit then 'resolvido' else status end",
    f"case when hit then {_iso(NOW)} else {_iso('resolved_at')} end", _NOTE,
    f"from ({_resolved('select * from led')})",
))
_ENDED = f"(status = 'aguardando' and wait_until < {NOW})"
SQL["pending_expire"] = _p(_led(
    f"case when {_ENDED} then 'expirado' else status end",
    f"case when {_ENDED} then {_iso(NOW)} else {_iso('resolved_at')} end", "note", "from led",
))
_BY_HAND = f"(status = 'aguardando' and rule_id = '{R12}' and cadusu_id in {_CHOSEN})"
SQL["pending_resolve"] = _p(_led(
    f"case when {_BY_HAND} then 'resolvido' else status end",
    f"case when {_BY_HAND} then {_iso(NOW)} else {_iso('resolved_at')} end",
    f"case when {_BY_HAND} then 'feito' else note end", "from led",
))
_LIVE = _resolved(f"select * from led where not {_ENDED}")
SQL["pending_list"] = _p(_led(
    *_ROW, f"from ({_LIVE}) where not hit and status = 'aguardando' and rule_id = '{R14}'"
    " order by applied_at desc nulls last, cadusu_id limit 25",
))
SQL["pending_summary"] = _p(
    f"select rule_id, count(*) as total from ({_LIVE}) where not hit and status = 'aguardando'"
    " group by rule_id"
)
SQL["pending_hwm"] = _p(
    "select max(numseq) as max_numseq, max(numseq) filter (where st_ = 'I') as previous_max_numseq,"
    " max(numseq) > max(numseq) filter (where st_ = 'I') as refreshed from r"
)
SQL["pending_interval"] = (
    "select event_id, user_id, case when exists (select 1 from events p where p.event_type ="
    " 'purchase' and p.user_id = e.user_id and p.ts > e.ts and p.ts <= e.ts + interval 2 day) then"
    " 'resolvido' else 'expirado' end as status from events e where event_type = 'error'"
)

# -- rejections ---

_ERRORS = (
    "with er as (select event_id, event_id // 4 as record, user_id,"
    " cast(json_extract_string(props, '$.k') as int) as k from events where event_type = 'error'),"
    " e as (select *, row_number() over (partition by record order by event_id) - 1 as position,"
    f" ([{', '.join(_q(x) for x in CODES)}])[k % {len(CODES)} + 1] as code from er),"
    " rec as (select record, lpad(cast(arg_min(user_id, event_id) + 1 as varchar), 12, '0') as cco,"
    " cast(record % 5 as varchar) as mv, ['', 'INCLUSAO', 'ALTERACAO', 'EXCLUSAO', 'REATIVACAO']"
    "[record % 5 + 1] as mn, arg_min(code, event_id) as code, arg_min(k, event_id) as k from e"
    " group by record), d as (select * from (values "
    + ", ".join(f"({_q(x)}, {_q(s)}, {_q(a)})" for x, (s, a, _, _) in ERROR_CODES.items())
    + ") v(d_code, sev, act))"
)


def _r(body: str, members: bool = False) -> str:
    if not members:
        return f"{_ERRORS} {body}"
    return f"{PRELUDE}, {_ERRORS[5:]} {body}"


_SEV = "coalesce(d.sev, 'media')"
_D = "left join d on d.d_code = {}.code"
_BY_HAND = ", ".join(f"({_q(code)}, {_q(what)})" for code, what in BY_HAND.items())
_LABEL = (
    "case act when 'posans_atualizado' then 'Apply: settle the movement' when 'posans_inclusao'"
    " then 'Apply: send as an inclusion' else '' end"
)
SQL["rej_explode"] = _r(
    "select rec.record, rec.cco, cast(rec.record as varchar) as codigo_beneficiario, rec.mv as"
    " codigo_tipo_movimento, rec.mn as tipo_movimento, e.position, e.code as codigo_erro,"
    " 'rejeitado' as mensagem_erro, cast(e.event_id % 7 as varchar) as codigo_campo, 'campo' as"
    " descricao_campo, cast(e.k as varchar) as valor_campo from e join rec using (record)"
)
SQL["rej_principal"] = _r(
    "select record, cco, code as codigo_erro, cast(k as varchar) as valor_campo,"
    f" {_SEV} as severidade, coalesce(act, '') as fix_action from rec {_D.format('rec')}"
)
SQL["rej_suggest"] = _r(
    f"select record, position, e.code as codigo_erro, {_SEV} as severidade, coalesce(act, '') as"
    f" fix_action, coalesce(act, '') <> '' as fixable, case act when 'posans_atualizado' then"
    " 'posans = 4-ATUALIZADO' when 'posans_inclusao' then 'codcco = NULL, posans = 1-INCLUSAO' else"
    f" 'correct by hand' || coalesce(': ' || h.what, '') end as acao_local, {_LABEL} as fix_label"
    f" from e {_D.format('e')} left join (values {_BY_HAND}) h(code, what) on h.code = e.code"
)
SQL["rej_by_code"] = _r(
    f"select code as codigo_erro, count(*) as quantidade, any_value({_SEV}) as severidade,"
    f" any_value(coalesce(act, '') <> '') as fixable from rec {_D.format('rec')} group by code"
)
SQL["rej_by_movement"] = _r(
    "select case when mn <> '' then mn else mv end as tipo_movimento, count(*) as quantidade"
    " from rec group by 1"
)
SQL["rej_by_severity"] = _r(
    f"select {_SEV} as severidade, count(*) as quantidade from rec {_D.format('rec')} group by 1"
)
_FIRST = "(select * from m where cco_ <> '' qualify row_number() over (partition by cco_ order by id) = 1)"
SQL["rej_enrich"] = _r(
    "select record, cco, cast(f.id as varchar) as cadusu_id, f.nomeusu as cadusu_nome, f.situusu as"
    " cadusu_situusu, f.posans as cadusu_posans, f.codusu as cadusu_codusu, cast(f.dataini as"
    " varchar) as cadusu_dataini, cast(f.datafim as varchar) as cadusu_datafim"
    f" from rec left join {_FIRST} f on f.cco_ = rec.cco", True
)
SQL["rej_matched"] = _r(
    "select count(*) as records, count(*) filter (where cco in (select cco_ from m)) as matched"
    " from rec", True
)
SQL["rej_eligible"] = _r(
    "select x.code as codigo_erro, any_value(d.act) as fix_action, count(*) filter (where"
    " case when d.act = 'posans_inclusao' then upper(trim(coalesce(f.situusu, ''), ' ')) = 'ATIVO'"
    " and coalesce(f.posans, '') in ('8-REINCLUSAO', '9-RET REATIV') else coalesce(f.posans, '') <>"
    " '4-ATUALIZADO' end) as elegiveis from (select distinct record, code from e) x join rec"
    f" using (record) join {_FIRST} f on f.cco_ = rec.cco join d on d.d_code = x.code"
    " where d.act <> '' group by x.code", True
)
SQL["rej_filter"] = _r(
    "select record, cco, code as codigo_erro, mn as tipo_movimento from rec where code = '3005'"
    " and mn = 'EXCLUSAO'"
)
SQL["rej_ccos_for_error"] = _r("select distinct cco from rec join e using (record) where e.code = '3011'")
SQL["rej_fix_updated"] = _r(
    "select id, codtit, codusu, nomeusu, situusu, codcco, posans as posans_atual, '4-ATUALIZADO' as"
    " posans_novo, cco_ as cco_ref, k.code as codigo_erro from m join (select distinct rec.cco, e.code"
    " from rec join e using (record) where e.code in ('3005', '3011')) k on k.cco = m.cco_"
    " where coalesce(posans, '') <> '4-ATUALIZADO'", True
)
SQL["src_rejections"] = _r(
    "select cast(record as varchar) as codigo_beneficiario, cco, mv as codigo_tipo_movimento, mn as"
    " tipo_movimento, (select string_agg(e.code, ',' order by e.position) from e where e.record ="
    " rec.record) as codes from rec where (record // 500) % 4 <> 3"
)
SQL["rej_fix_inclusion"] = _r(
    "select id, case when hit then '1-INCLUSAO' else posans end as posans, case when not hit then"
    f" codcco end as codcco, case when hit then cast({DAY} as varchar) end as dataultalt from"
    " (select *, situusu = 'ATIVO' and coalesce(posans in ('8-REINCLUSAO', '9-RET REATIV'), false)"
    " and cco_ in (select rec.cco from rec join e using (record) where e.code = '3205') as hit"
    " from m)", True
)
SQL["stream_latest"] = SQL["stream_latest_table"] = (
    "select user_id, event_id, event_type from events qualify row_number() over (partition by"
    " user_id order by event_id desc) = 1"
)
SQL["stream_pending"] = (
    "with er as (select distinct user_id, ts from events where event_type = 'error'),"
    " last as (select max(ts) - interval 96 hour as last from events),"
    " o as (select user_id, ts, exists (select 1 from events p where p.event_type = 'purchase' and"
    " p.user_id = er.user_id and p.ts > er.ts and p.ts <= er.ts + interval 48 hour) as seen from er"
    " where not exists (select 1 from er r where r.user_id = er.user_id and r.ts > er.ts and r.ts <="
    " er.ts + interval 48 hour))"
    " select user_id as cadusu_id, case when seen then 'resolvido' else 'expirado' end as status,"
    " count(*) as n from o, last where ts < last group by all"
)
SQL["stream_pending_timers"] = (
    "with a as (select user_id, ts, lead(ts) over (partition by user_id order by ts) as r from"
    " (select distinct user_id, ts from events where event_type = 'error')),"
    " b as (select a.*, ts + interval 48 hour as u, (select min(p.ts) from events p where p.event_type ="
    " 'purchase' and p.user_id = a.user_id and p.ts > a.ts) as p from a),"
    " d as (select *, case when p <= u and (r is null or p <= r) then 'resolvido' when r <= u then"
    " 'renovado' else 'expirado' end as s from b),"
    " o as (select *, case s when 'resolvido' then p when 'renovado' then r else u end as due from d)"
    " select user_id as cadusu_id, case when due <= (select max(ts) - interval 1 hour from events where"
    " event_type in ('error', 'purchase')) then s"
    " else 'aguardando' end as status, count(*) as n from o group by all"
)
SQL["page_at"] = (
    "with r as (select o_orderkey, o_totalprice, o_orderstatus, row_number() over (order by o_totalprice"
    " desc nulls last, o_orderkey) - 1 as place, count(*) over () as n from orders)"
    " select o_orderkey, o_totalprice, o_orderstatus, place, cast(place // 40 as int) as page from r"
    " where place // 40 in (0, ((n - 1) // 40) // 2, (n - 1) // 40)"
)

# -- files written and read back: 500 record numbers to a file, every fourth no result ---

_FILES = (
    ", inc as (select event_id // 4 as record, event_id, user_id from events where event_type = 'purchase'),"
    " f as (select distinct record // 500 as file from (select record from rec union all select record"
    " from inc))"
)
SQL["stream_rejection_files"] = _r(
    "select cast(record as varchar) as codigo_beneficiario, cco, cast((select count(*) from e where e.record ="
    " rec.record) as int) as errors from rec where (record // 500) % 4 <> 3"
)
SQL["src_inclusions"] = (
    "select cast(event_id as varchar) as codigo_beneficiario, lpad(cast(user_id + 1 as varchar), 12, '0') as"
    " cco, 'PESSOA ' || user_id as nome_beneficiario from events where event_type = 'purchase' and"
    " (event_id // 4 // 500) % 4 <> 3"
)


def _f(body: str) -> str:
    head, tail = _ERRORS.rsplit(", d as (", 1)
    return f"{head}, d as ({tail}{_FILES}{body}"


SQL["src_file_headers"] = _f(
    " select 'RESULTADO' as tipo_transacao, cast(file as varchar) as sequencial, '2001-10-31T12:00:00' as"
    " data_hora, '00000000000191' as cnpj_origem, '123456' as registro_ans, '1.1' as versao_padrao, 'H' ||"
    " file as hash, 'P' || file as numero_protocolo, 'F' || file || '.SBX' as nome_arquivo from f where file % 4 <> 3"
)
SQL["src_invalid_files"] = _f(" select file from f where file % 4 = 3")
SQL["src_error_totals"] = _f(
    " select cast(e.record // 500 as varchar) as sequencial, e.code as codigo_erro, 'rejeitado' as mensagem_erro,"
    f" count(*) as quantidade, {_SEV} as severidade from e {_D.format('e')} where (e.record // 500) % 4 <> 3"
    " group by all"
)
SQL["src_movement_totals"] = _f(
    ", t as (select record // 500 as file, case mn when '' then '' else mn[1] || lower(mn[2:]) end as tipo, 1 as"
    " rej, 0 as ok from rec union all select record // 500, 'Inclusao', 0, 1 from inc),"
    " t2 as (select * from t union all select file, 'Total', rej, ok from t)"
    " select cast(file as varchar) as sequencial, tipo, count(*) as quantidade_registros, sum(ok)::bigint as"
    " quantidade_processados, sum(rej)::bigint as quantidade_rejeitados, round(round(sum(ok) * 100 / count(*), 2), 1)"
    " as percentual_acerto from t2 where file % 4 <> 3 group by file, tipo"
)
SQL["sink_csv"] = (
    "select coalesce(cast(columns(*) as varchar), '') from"
    f" ({rule_sql('divergencia_nome_cadusu_confsib')})"
)
SQL["fix_paired_changes"] = (
    "select id, 'codans' as field, codans_atual as old_value, codans_novo as new_value from"
    f" ({fix_sql('cadusu_sem_codans')}) where codans_atual is distinct from codans_novo"
)
