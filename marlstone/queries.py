"""The registered queries: scripts for the engine over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

Query = Callable[[SparkSession, str], DataFrame]


def ci(x: str) -> str:
    return f"lower(rtrim({x}))"


#: Script and oracle, by name.
SCRIPTS: dict[str, tuple[str, str]] = {
    # projection and expressions
    "scan_project": ("select n_nationkey, n_name from nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"),
    "select_star": ("select * from region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"),
    "select_tstar": (
        "select n.*, r_name from nation n join region r on n.n_regionkey = r.r_regionkey",
        "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "column_alias": ("select c_custkey id, c_name as [Customer Name] from customer", 'SELECT c_custkey AS id, c_name AS "Customer Name" FROM customer'),
    "fromless": ("select 1 a, 2.5 b, 'it''s' c, 0x1F d", "SELECT 1::BIGINT AS a, 2.5::DOUBLE AS b, 'it''s' AS c, 31::BIGINT AS d"),
    "line_constants": ("select n_nationkey, n_name + __lf + __crlf + __cr marks from nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name || chr(10) || chr(13) || chr(10) || chr(13) AS marks FROM nation"),
    "arith_int": (
        "select l_orderkey, l_linenumber, l_linenumber * 2 + 1 a, l_orderkey / 7 b, l_orderkey % 7 c, -l_orderkey / 4 d from lineitem",
        "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_linenumber * 2 + 1)::BIGINT AS a, l_orderkey // 7 AS b, l_orderkey % 7 AS c, (-l_orderkey) // 4 AS d FROM lineitem",
    ),
    "arith_float": ("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) net from lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "arith_mixed": ("select p_partkey, p_size / 2.0 half, p_size + 0.5 more from part", "SELECT p_partkey, p_size / 2.0::DOUBLE AS half, p_size + 0.5::DOUBLE AS more FROM part"),
    "bitops": (
        "select l_orderkey, l_linenumber, l_orderkey & 6 a, l_orderkey | 5 b, l_orderkey ^ 3 c from lineitem",
        "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey & 6 AS a, l_orderkey | 5 AS b, xor(l_orderkey, 3) AS c FROM lineitem",
    ),
    "unary": ("select c_custkey, ~c_custkey a, -c_acctbal b, +c_custkey c from customer", "SELECT c_custkey, ~c_custkey AS a, -c_acctbal AS b, c_custkey AS c FROM customer"),
    "concat_plus": ("select l_orderkey, l_linenumber, l_returnflag + l_linestatus + '!' flags from lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag || l_linestatus || '!' AS flags FROM lineitem"),
    "promote_string_num": ("select p_partkey, '6' + p_size a, '1' + '9' + 5 b from part", "SELECT p_partkey, (6 + p_size)::BIGINT AS a, 24::BIGINT AS b FROM part"),
    "precedence": ("select p_partkey, 2 + p_size * 3 - 8 / 4 & 6 a, (2 + p_size) * 3 b from part", "SELECT p_partkey, ((2 + p_size * 3 - 2) & 6)::BIGINT AS a, ((2 + p_size) * 3)::BIGINT AS b FROM part"),
    # functions
    "fn_len": ("select doc_id, len(text) n, len(doc_id) m from documents", "SELECT doc_id, length(regexp_replace(text, '\\s+$', ''))::BIGINT AS n, length(doc_id::VARCHAR)::BIGINT AS m FROM documents"),
    "fn_datalength": ("select doc_id, datalength(text) n, datalength(doc_id) m from documents", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n, 8::BIGINT AS m FROM documents"),
    "fn_left": ("select doc_id, left(text, 12) a from documents", "SELECT doc_id, left(text, 12) AS a FROM documents"),
    "fn_right": ("select doc_id, right(text, 9) a from documents", "SELECT doc_id, right(text, 9) AS a FROM documents"),
    "fn_substring": ("select doc_id, substring(text, 3, 20) a from documents", "SELECT doc_id, substring(text, 3, 20) AS a FROM documents"),
    "fn_substring_neg": ("select doc_id, substring(text, -2, 9) a from documents", "SELECT doc_id, left(text, 6) AS a FROM documents"),
    "fn_replace": ("select c_custkey, replace(c_name, 'CUSTOMER', 'client') a from customer", "SELECT c_custkey, regexp_replace(c_name, 'CUSTOMER', 'client', 'gi') AS a FROM customer"),
    "fn_isnull": (
        "select c_custkey, isnull(o_orderkey, -1) a from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000",
        "SELECT c_custkey, coalesce(o_orderkey, -1) AS a FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    ),
    "cast_int": ("select o_orderkey, cast(o_totalprice as int) a, cast(left('007', 3) as bigint) b from orders", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS a, 7::BIGINT AS b FROM orders"),
    "cast_bit": ("select l_orderkey, l_linenumber, cast(l_linenumber - 1 as bit) a from lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END::BIGINT AS a FROM lineitem"),
    "cast_float": ("select p_partkey, cast(p_size as float) / 8 a, cast('2.5' as real) b from part", "SELECT p_partkey, p_size::DOUBLE / 8 AS a, 2.5::DOUBLE AS b FROM part"),
    "cast_varchar_n": ("select p_partkey, cast(p_type as varchar(5)) a, cast(p_size as varchar) b from part", "SELECT p_partkey, left(p_type, 5) AS a, p_size::VARCHAR AS b FROM part"),
    "cast_char_n": ("select p_partkey, cast(p_size as char(6)) + '|' a from part", "SELECT p_partkey, rpad(p_size::VARCHAR, 6, ' ') || '|' AS a FROM part"),
    "cast_hex": ("select n_nationkey, cast('0x' + right(n_nationkey, 1) as int) a from nation", "SELECT n_nationkey::BIGINT AS n_nationkey, right(n_nationkey::VARCHAR, 1)::BIGINT AS a FROM nation"),
    "case_searched": (
        "select l_orderkey, l_linenumber, case when l_quantity > 40 then 'big' when l_quantity > 20 then 'middle' else 'small' end size from lineitem",
        "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 20 THEN 'middle' ELSE 'small' END AS size FROM lineitem",
    ),
    "case_simple": (
        "select o_orderkey, case o_orderstatus when 'f' then 1 when 'O  ' then '2' end a from orders",
        "SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'f' THEN 1 WHEN 'o' THEN 2 END::BIGINT AS a FROM orders",
    ),
    # conditions
    "cmp_numeric": ("select o_orderkey from orders where o_totalprice >= 100000 and o_custkey < 500 and o_orderkey <> 7 and o_orderkey !> 9000", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_custkey < 500 AND o_orderkey <> 7 AND o_orderkey <= 9000"),
    "cmp_string_ci": (
        "select c_custkey from customer where c_mktsegment > 'building' and c_mktsegment != 'MACHINERY  '",
        f"SELECT c_custkey FROM customer WHERE {ci('c_mktsegment')} > 'building' AND {ci('c_mktsegment')} <> 'machinery'",
    ),
    "in_list": ("select o_orderkey from orders where o_orderpriority in ('1-urgent', '2-HIGH  ') and o_custkey % 5 in (1, '3', null)", f"SELECT o_orderkey FROM orders WHERE {ci('o_orderpriority')} IN ('1-urgent', '2-high') AND o_custkey % 5 IN (1, 3)"),
    "not_in_list": ("select o_orderkey from orders where o_orderstatus not in ('f', 'p')", f"SELECT o_orderkey FROM orders WHERE {ci('o_orderstatus')} NOT IN ('f', 'p')"),
    "in_list_columns": ("select l_orderkey, l_linenumber from lineitem where l_linenumber in (l_quantity, 1, l_suppkey % 7)", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_linenumber IN (l_quantity, 1, l_suppkey % 7)"),
    "in_subquery": ("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 250000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "not_in_subquery": (
        "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 200000)",
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    ),
    "in_subquery_or": (
        "select c_custkey from customer where c_custkey < 10 or c_name in (select 'customer#' + right('000000000' + cast(c_custkey as varchar), 9) from customer where c_acctbal > 9000)",
        "SELECT c_custkey FROM customer WHERE c_custkey < 10 OR lower(c_name) IN (SELECT 'customer#' || right('000000000' || c_custkey::VARCHAR, 9) FROM customer WHERE c_acctbal > 9000)",
    ),
    "like_pct": ("select c_custkey from customer where c_mktsegment like '%ING' or c_name like 'CUST%99'", "SELECT c_custkey FROM customer WHERE regexp_full_match(c_mktsegment, '.*ing', 'i') OR regexp_full_match(c_name, 'cust.*99', 'i')"),
    "like_underscore": ("select c_custkey from customer where c_name like 'customer_0000____1'", "SELECT c_custkey FROM customer WHERE regexp_full_match(c_name, 'customer.0000....1', 'i')"),
    "like_range": ("select s_suppkey from supplier where s_name like '%[1-3][05-9]'", "SELECT s_suppkey FROM supplier WHERE regexp_full_match(s_name, '.*[1-3][05-9]', 'i')"),
    "not_like": ("select s_suppkey from supplier where s_name not like '%1%'", "SELECT s_suppkey FROM supplier WHERE s_name NOT LIKE '%1%'"),
    "like_column": ("select c_custkey, s_suppkey from customer join supplier on c_name like '%' + right(s_name, 3) and s_suppkey < 9", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_name LIKE '%' || right(s_name, 3) AND s_suppkey < 9"),
    "is_null": (
        "select c_custkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000 where o_orderkey is null",
        "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 WHERE o_orderkey IS NULL",
    ),
    "is_not_null": ("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey where o_orderkey is not null", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"),
    "between": ("select o_orderkey from orders where o_orderkey between 100 and 200 or o_orderstatus not between 'a' and 'o'", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 200 OR lower(o_orderstatus) NOT BETWEEN 'a' AND 'o'"),
    "and_or_prec": ("select o_orderkey from orders where o_orderstatus = 'F' or o_orderstatus = 'P' and o_totalprice > 200000", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'P' AND o_totalprice > 200000"),
    "not_cond": ("select o_orderkey from orders where not (o_orderstatus = 'F' or o_totalprice > 150000)", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 150000)"),
    "not_null_two_valued": (
        "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 150000 where not o_totalprice > 250000",
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000 WHERE coalesce(o_totalprice, 0) <= 250000",
    ),
    # subqueries
    "scalar_subquery": ("select c_custkey, c_acctbal - (select min(s_acctbal) from supplier) a from customer where c_custkey > (select count(*) from nation)", "SELECT c_custkey, c_acctbal - (SELECT min(s_acctbal) FROM supplier) AS a FROM customer WHERE c_custkey > (SELECT count(*) FROM nation)"),
    "scalar_subquery_nested": ("select (select (select max(r_regionkey) from region) + 1) a, (select n_name from nation where n_nationkey = -1) b", "SELECT (SELECT max(r_regionkey) FROM region)::BIGINT + 1 AS a, NULL::VARCHAR AS b"),
    "top1_subquery": ("select s_suppkey, (select top 1 n_name from nation order by n_nationkey desc) a from supplier", "SELECT s_suppkey, (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 1) AS a FROM supplier"),
    "derived_table": ("select flag, n from (select l_returnflag flag, count(*) n from lineitem group by l_returnflag) x where n > 10", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10"),
    "derived_nested": (
        "select k from (select j k from (select n_nationkey j, n_regionkey from nation where n_regionkey > 1) a where j > 5) b where k < 20",
        "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_regionkey > 1 AND n_nationkey > 5 AND n_nationkey < 20",
    ),
    # joins
    "join_inner": ("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_string_ci": (
        "select a.c_custkey, b.c_custkey other from customer a join customer b on a.c_name = left(b.c_name, 8) + right(b.c_name, 10) + '  ' and a.c_mktsegment = b.c_mktsegment",
        "SELECT a.c_custkey, b.c_custkey AS other FROM customer a JOIN customer b ON lower(a.c_name) = lower(left(b.c_name, 8) || right(b.c_name, 10)) AND a.c_mktsegment = b.c_mktsegment",
    ),
    "join_expr_key": ("select s_suppkey, n_name from supplier join nation on right(s_suppkey, 1) = right(n_nationkey, 1)", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON right(s_suppkey::VARCHAR, 1) = right(n_nationkey::VARCHAR, 1)"),
    "join_residual": ("select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey and l_extendedprice * 3 > o_totalprice", "SELECT o_orderkey, l_linenumber::BIGINT AS l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice * 3 > o_totalprice"),
    "join_left": ("select c_custkey, o_orderkey from customer left outer join orders on c_custkey = o_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "join_left_residual": ("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000"),
    "join_theta": ("select r_regionkey, n_nationkey from region join nation on n_regionkey < r_regionkey", "SELECT r_regionkey::BIGINT AS r_regionkey, n_nationkey::BIGINT AS n_nationkey FROM region JOIN nation ON n_regionkey < r_regionkey"),
    "join_self": ("select a.n_name, b.n_name other from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", "SELECT a.n_name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_multi": (
        "select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'asia'",
        "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'asia'",
    ),
    "join_derived": ("select c_custkey, n from customer join (select o_custkey k, count(*) n from orders group by o_custkey) x on x.k = c_custkey", "SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) x ON x.k = c_custkey"),
    # groups
    "group_single": ("select l_returnflag, count(*) n from lineitem group by l_returnflag", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
    "group_multi": ("select l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) q from lineitem group by l_returnflag, l_linestatus, l_linenumber", "SELECT l_returnflag, l_linestatus, l_linenumber::BIGINT AS l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL"),
    "group_expr": ("select o_custkey + 2 a, count(*) n from orders group by o_custkey + (4 * 3) / 6", "SELECT o_custkey + 2 AS a, count(*) AS n FROM orders GROUP BY o_custkey + 2"),
    "group_expr_outer": ("select len(p_brand) + '1' a, max(p_size) m from part group by p_brand", "SELECT (length(p_brand) + 1)::BIGINT AS a, max(p_size)::BIGINT AS m FROM part GROUP BY p_brand"),
    "group_ci": (
        "select max(x) a, count(*) n from (select n_name x, n_nationkey k from nation union all select replace(n_name, 'a', 'A') + ' ', n_nationkey from nation) u group by x",
        "SELECT n_name AS a, 2::BIGINT AS n FROM nation",
    ),
    "group_constant": ("select count(*) n, 3 k from nation group by 3", "SELECT count(*) AS n, 3::BIGINT AS k FROM nation"),
    "global_agg": ("select count(*) n, sum(o_custkey) s, min(o_totalprice) a, max(o_orderkey) b, avg(o_custkey) c from orders", "SELECT count(*) AS n, sum(o_custkey)::BIGINT AS s, min(o_totalprice) AS a, max(o_orderkey) AS b, (sum(o_custkey) // count(*))::BIGINT AS c FROM orders"),
    "agg_empty": ("select count(*) n, sum(o_custkey) s, min(o_orderstatus) m from orders where 1 = 0", "SELECT 0::BIGINT AS n, NULL::BIGINT AS s, NULL::VARCHAR AS m"),
    "agg_count": ("select c_nationkey, count(*) a, count(c_name) b from customer group by c_nationkey", "SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS a, count(*) AS b FROM customer GROUP BY c_nationkey"),
    "agg_distinct": ("select o_orderstatus, count(distinct o_custkey) a, sum(distinct o_custkey) b from orders group by o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS a, sum(DISTINCT o_custkey)::BIGINT AS b FROM orders GROUP BY o_orderstatus"),
    "agg_min_max": ("select l_returnflag, min(l_quantity) a, max(l_extendedprice) b, max(l_linenumber) c from lineitem group by l_returnflag", "SELECT l_returnflag, min(l_quantity) AS a, max(l_extendedprice) AS b, max(l_linenumber)::BIGINT AS c FROM lineitem GROUP BY l_returnflag"),
    "agg_min_max_str": ("select c_nationkey, min(c_name) a, max(c_mktsegment) b from customer group by c_nationkey", "SELECT c_nationkey::BIGINT AS c_nationkey, min(c_name) AS a, max(c_mktsegment) AS b FROM customer GROUP BY c_nationkey"),
    "agg_sum": ("select l_linestatus, sum(l_quantity) a, sum(l_partkey) b, sum(cast(l_extendedprice * 100 as int)) c from lineitem group by l_linestatus", "SELECT l_linestatus, sum(l_quantity) AS a, sum(l_partkey)::BIGINT AS b, sum(trunc(l_extendedprice * 100)::BIGINT)::BIGINT AS c FROM lineitem GROUP BY l_linestatus"),
    "agg_avg_int": ("select l_returnflag, avg(l_partkey) a from lineitem group by l_returnflag", "SELECT l_returnflag, (sum(l_partkey) // count(*))::BIGINT AS a FROM lineitem GROUP BY l_returnflag"),
    "agg_avg_float": ("select l_returnflag, avg(l_quantity) a from lineitem group by l_returnflag", "SELECT l_returnflag, avg(l_quantity) AS a FROM lineitem GROUP BY l_returnflag"),
    "lazy_pivot": (
        "select o_orderpriority, sum(case when o_orderstatus = 'F' then 1 else 0 end) done, sum(case when o_orderstatus = 'o' then 1 else 0 end) is_open, count(*) total from orders group by o_orderpriority",
        "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS is_open, count(*) AS total FROM orders GROUP BY o_orderpriority",
    ),
    "having": ("select o_custkey, count(*) n from orders group by o_custkey having count(*) > 12 and min(o_totalprice) < 50000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 50000"),
    "having_global": ("select count(*) n from nation having max(n_nationkey) > 3", "SELECT count(*) AS n FROM nation HAVING max(n_nationkey) > 3"),
    "distinct": ("select distinct l_returnflag, l_linenumber from lineitem", "SELECT DISTINCT l_returnflag, l_linenumber::BIGINT AS l_linenumber FROM lineitem"),
    "distinct_ci": ("select distinct flag from (select l_returnflag flag from lineitem union all select l_returnflag + ' ' from lineitem) x where len(flag) = datalength(flag)", "SELECT DISTINCT l_returnflag AS flag FROM lineitem"),
    # order and limits
    "order_ordinal_top": ("select top 20 o_orderkey, o_totalprice from orders order by 2 desc, 1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 20"),
    "order_alias_top": ("select top 15 c_custkey, c_acctbal * -1 debt from customer order by debt, c_custkey", "SELECT c_custkey, c_acctbal * -1 AS debt FROM customer ORDER BY 2, 1 LIMIT 15"),
    "order_expr_top": ("select top 9 o_custkey from orders group by o_custkey order by count(*) desc, max(o_orderkey) - 1", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, max(o_orderkey) LIMIT 9"),
    "order_string_ci": ("select top 30 p_partkey from part order by p_brand, p_type desc, p_partkey", f"SELECT p_partkey FROM part ORDER BY {ci('p_brand')}, {ci('p_type')} DESC, p_partkey LIMIT 30"),
    "top_expr": ("select top ((5 * 2) / 4) n_name from nation order by n_nationkey", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 2"),
    "top_file_order": ("select top 7 o_orderkey from orders where o_totalprice > 1000", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER () AS i, o_totalprice FROM orders) WHERE o_totalprice > 1000 ORDER BY i LIMIT 7"),
    "order_full": ("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM lineitem"),
    # unions
    "union_all": ("select n_name from nation union all select r_name from region", "SELECT n_name FROM nation UNION ALL SELECT r_name FROM region"),
    "union_all_types": ("select n_nationkey k from nation union all select s_acctbal from supplier union all select '7'", "SELECT n_nationkey::DOUBLE AS k FROM nation UNION ALL SELECT s_acctbal FROM supplier UNION ALL SELECT 7.0"),
    "union_all_distinct_branch": ("select n_regionkey k from nation union all select distinct n_regionkey from nation", "SELECT n_regionkey::BIGINT AS k FROM nation UNION ALL SELECT DISTINCT n_regionkey::BIGINT FROM nation"),
    "union_top": ("select top 2 n_name from nation order by n_name", "SELECT n_name FROM nation ORDER BY n_name LIMIT 2"),
    "union_top_branch": ("select top 2 r_name from region union all select top 3 n_name from nation", "(SELECT r_name FROM region LIMIT 2) UNION ALL (SELECT n_name FROM nation LIMIT 3)"),
    "union_order": ("select n_name, n_nationkey k from nation union all select r_name, r_regionkey from region order by k desc, 1", "SELECT n_name, n_nationkey::BIGINT AS k FROM nation UNION ALL SELECT r_name, r_regionkey::BIGINT FROM region"),
    # rows
    "rownum": ("select __rownum n, o_orderkey from orders where o_orderstatus = 'f'", "SELECT row_number() OVER (ORDER BY i) AS n, o_orderkey FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER () AS i FROM orders) WHERE o_orderstatus = 'F'"),
    "rec": ("select r_regionkey, __rec line from region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_regionkey::VARCHAR || ',' || r_name AS line FROM region"),
    "fuzzy_names": ("select count(*) n from LINEITEM union all select count(*) from [Orders.PARQUET]", "SELECT count(*) AS n FROM lineitem UNION ALL SELECT count(*) FROM orders"),
    # scripts
    "script_while": ("declare @i int = 0 while @i < 5 begin set @i += 2 end select @i a, n_name from nation where n_nationkey = @i", "SELECT 6::BIGINT AS a, n_name FROM nation WHERE n_nationkey = 6"),
    "script_if": (
        "if (select count(*) from region) > 100 select 'many' a else if 1 = 1 begin select n_name a from nation where n_regionkey = 2 end",
        "SELECT n_name AS a FROM nation WHERE n_regionkey = 2",
    ),
    "script_vars": (
        "declare @least float = 150000, @flag varchar(1) = 'Open' declare @n int set @n = (select max(o_custkey) from orders) set @n /= 2 select o_orderkey from orders where o_totalprice > @least and o_orderstatus = @flag and o_custkey < @n",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O' AND o_custkey < (SELECT max(o_custkey) // 2 FROM orders)",
    ),
    "everything": (
        "declare @share float = 0.25 "
        "select status, nation, count(distinct o_custkey) buyers, max(spent) spent, case when max(spent) > 200000 then 'large' else 'small' end size "
        "from (select o_orderstatus status, o_custkey, o_totalprice * (1 - @share) spent, replace(n_name, 'nation', 'N') nation from orders join customer on c_custkey = o_custkey "
        "left join nation on n_nationkey = c_nationkey and n_regionkey between 1 and 3 where o_orderkey % 3 <> 1) x "
        "where nation is not null group by status, nation having count(*) > 1 and min(spent) < (select max(s_acctbal) * 2 from supplier) "
        "union all select top 3 'all', isnull(r_name, '-'), 0, cast(r_regionkey as float), 'none' from region where r_regionkey in (select n_regionkey from nation) order by nation desc, status",
        "SELECT * FROM (SELECT o_orderstatus AS status, replace(n_name, 'NATION', 'N') AS nation, count(DISTINCT o_custkey) AS buyers, max(o_totalprice * 0.75::DOUBLE) AS spent, CASE WHEN max(o_totalprice * 0.75::DOUBLE) > 200000 THEN 'large' ELSE 'small' END AS size "
        "FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey AND n_regionkey BETWEEN 1 AND 3 WHERE o_orderkey % 3 <> 1 "
        "GROUP BY o_orderstatus, n_name HAVING count(*) > 1 AND min(o_totalprice * 0.75::DOUBLE) < (SELECT max(s_acctbal) * 2 FROM supplier)) "
        "UNION ALL (SELECT 'all', r_name, 0, r_regionkey::DOUBLE, 'none' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) LIMIT 3)",
    ),
    "not_above_below": ("select o_orderkey from orders where o_custkey !> 40 or o_totalprice !< 290000", "SELECT o_orderkey FROM orders WHERE o_custkey <= 40 OR o_totalprice >= 290000"),
    "flagship": (
        "select l_returnflag, l_linestatus, count(*) n, sum(l_quantity) q, max(l_extendedprice * (1 - l_discount)) best from lineitem where l_linestatus = 'o' or l_quantity > 10 group by l_returnflag, l_linestatus order by n desc",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, max(l_extendedprice * (1 - l_discount)) AS best FROM lineitem WHERE lower(l_linestatus) = 'o' OR l_quantity > 10 GROUP BY ALL",
    ),
    # the shapes of the published measurements
    "bench_join": ("select * from orders a join customer b on a.o_custkey = b.c_custkey", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"),
    "bench_group": ("select l_returnflag, count(*) n from lineitem group by l_returnflag", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
    "bench_like": ("select p_name from part where p_name like '%a[a-m][0-9a-z]%'", "SELECT p_name FROM part WHERE regexp_matches(p_name, 'a[a-m][0-9a-z]', 'i')"),
    "bench_order": ("select o_orderkey, o_custkey, o_totalprice from orders order by o_orderpriority, o_totalprice desc", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"),
}


def _script(sql: str) -> Query:
    return lambda spark, sf_dir: Engine(spark, sf_dir).query(sql)


def _folder(spark: SparkSession) -> str:
    """Where the writing queries put their files: a folder that all executors share, if the session names one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""
    folder = shared.removeprefix("file://")
    if not folder.startswith("/"):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("text files need a mounted folder that all executors share in spark.checkpoint.dir")
        return tempfile.mkdtemp(prefix="marlstone-")
    os.makedirs(folder, exist_ok=True)
    return tempfile.mkdtemp(prefix="marlstone-", dir=folder)


def _writing(sql: str, files: dict[str, str] | None = None, variables: dict[str, str] | None = None, parts: int = 0, stdin: bytes = b"", step: int = 0, lines: bool = False, **properties: object) -> Query:
    """A script over copies in a new folder; parts: with the customers, by key, in a Parquet table `many` of so many files;
    step: run up to that SELECT only; lines: what the command line would print, a row for each line with its terminator.
    """
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _folder(spark)
        for name, text in (files or {}).items():
            with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
                f.write(text)
        engine = Engine(spark, folder, io.BytesIO(stdin), overwrite=True, allow_stdin=bool(stdin), **properties)
        for name in ("region", "nation", "customer", "orders", "supplier", "part"):
            engine.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        for name, value in (variables or {}).items():
            engine.import_variable(f"{name}={value}")
        if parts:
            spark.read.parquet(f"{sf_dir}/customer.parquet").repartitionByRange(parts, "c_custkey").sortWithinPartitions("c_custkey").write.parquet(f"file://{folder}/many.parquet")
        if lines:  # of a few rows
            return spark.createDataFrame([(line,) for line in engine.text(engine.execute(sql)[-1])], "line string")
        if step:
            engine.prepare(sql)
            return [engine.until_select() for _ in range(step)][-1].result.named()
        return engine.query(sql)

    return run


#: Queries that write files first; oracle None: the rows alone are checked.
WRITERS: dict[str, tuple[Query, str | None]] = {
    "select_into": (
        _writing("select o_orderkey, o_orderstatus, o_totalprice into [big.csv] from orders where o_totalprice > 200000 select * from [big.csv]"),
        "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_totalprice > 200000",
    ),
    "select_into_parquet": (_writing("select o_orderkey, o_orderdate into [o.parquet] from orders select * from [o.parquet]"), "SELECT o_orderkey, o_orderdate FROM orders"),
    "update_where": (
        _writing("select * into [n.tsv] from nation update [n.tsv] set n_name = 'x' + n_name, n_regionkey += 10 where n_regionkey = 2 select n_nationkey, n_name, n_regionkey from [n.tsv]"),
        "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 2 THEN 'x' || n_name ELSE n_name END AS n_name, (n_regionkey + CASE WHEN n_regionkey = 2 THEN 10 ELSE 0 END)::BIGINT AS n_regionkey FROM nation",
    ),
    "update_join": (
        _writing("select c_custkey, c_name, c_mktsegment into [c.csv] from customer update c set c_mktsegment = 'buyer' from [c.csv] c join orders o on o.o_custkey = c.c_custkey where o.o_totalprice > 250000 select * from [c.csv]"),
        "SELECT c_custkey, c_name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) THEN 'buyer' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    ),
    "delete_where": (_writing("select * into [s.csv] from supplier delete [s.csv] where s_acctbal < 0 select s_suppkey, s_name from [s.csv]"), "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0"),
    "delete_all": (_writing("select * into [s.csv] from supplier delete [s.csv] select count(*) n from [s.csv]"), "SELECT 0::BIGINT AS n"),
    "delete_join": (
        _writing("select * into [c.parquet] from customer delete c from [c.parquet] c join orders on c.c_custkey = o_custkey and o_totalprice > 200000 select c_custkey, c_acctbal from [c.parquet]"),
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    ),
    "delete_join_files": (
        _writing("delete c from many c join orders on c.c_custkey = o_custkey and o_totalprice > 200000 select c_custkey, c_acctbal from many", parts=7),
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    ),
    "update_join_files": (
        _writing("update c set c_mktsegment = 'buyer', c_acctbal += 1 from many c join orders o on o.o_custkey = c.c_custkey where o.o_totalprice > 250000 select c_custkey, c_acctbal, c_mktsegment from many", parts=7),
        "SELECT c_custkey, c_acctbal + CASE WHEN b THEN 1 ELSE 0 END AS c_acctbal, CASE WHEN b THEN 'buyer' ELSE c_mktsegment END AS c_mktsegment FROM (SELECT *, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AS b FROM customer)",
    ),
    "top_file_order_files": (
        _writing("select top 25 c_custkey from many where c_acctbal > 0", parts=7),
        "SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 25",
    ),
    "temp_table": (_writing("select distinct n_regionkey k into #keys from nation where n_nationkey > 3 select r_name from region join #keys on k = r_regionkey"), "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey > 3)"),
    "table_variable": (_writing("select n_name, n_regionkey into @file from nation where n_nationkey < 9 select n_name from @file where n_regionkey = 1", variables={"file": "some.csv"}), "SELECT n_name FROM nation WHERE n_nationkey < 9 AND n_regionkey = 1"),
    "csv_roundtrip": (
        _writing("select n_nationkey, n_name + ', \"' + n_name + '\"' name into [q.csv] from nation select cast(n_nationkey as int) k, name from [q.csv]"),
        "SELECT n_nationkey::BIGINT AS k, n_name || ', \"' || n_name || '\"' AS name FROM nation",
    ),
    "fixed_roundtrip": (
        _writing("select name, code, eor into [out.txt] from wide.[in.txt] where code > '02' select name, code from wide.[out.txt]", {"in.txt": "alpha 01\nbeta  02\ngamma 03\ndelta 04\n", "wide.schema": "name,6,c\ncode,2,c\neor,1,c\n"}),
        "SELECT * FROM (VALUES ('gamma ', '03'), ('delta ', '04')) t(name, code)",
    ),
    "noheader": (_writing("select __3, __1 from noheader.[plain] where __2 = 'B'", {"plain.txt": "1\tb\tx\n2\tc\ty\n3\tB \tz\n"}), "SELECT * FROM (VALUES ('x', '1'), ('z', '3')) t(__3, __1)"),
    "mixed_format_join": (
        _writing("select r_name, label from [labels.psv] l join region on r_regionkey = l.id join wide.[codes.txt] c on c.id = l.id", {"labels.psv": "id|label\n1|one\n3|three\n", "codes.txt": "1 a\n2 b\n3 c\n", "wide.schema": "id,2,c\nletter,1,c\neor,1,c\n"}),
        "SELECT r_name, CASE r_regionkey WHEN 1 THEN 'one' ELSE 'three' END AS label FROM region WHERE r_regionkey IN (1, 3)",
    ),
    "loose_groups": (_writing("select n_regionkey, r_name from nation join region on r_regionkey = n_regionkey group by n_regionkey", loose_groups=True), "SELECT DISTINCT n_regionkey::BIGINT AS n_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "char_as_byte": (_writing("select n_nationkey, left('é' + n_name, 3) a, len('é' + n_name) b from nation", char_as_byte=True), "SELECT n_nationkey::BIGINT AS n_nationkey, 'é' || left(n_name, 1) AS a, (length(n_name) + 2)::BIGINT AS b FROM nation"),
    "force_cartesian": (_writing("select n_name, r_name from nation join region on n_regionkey = r_regionkey", force_cartesian=True), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "rownum_join": (_writing("select __rownum n from nation join region on n_regionkey >= r_regionkey"), "SELECT row_number() OVER () AS n FROM nation JOIN region ON n_regionkey >= r_regionkey"),
    "stdin_join": (
        _writing("select r_name, s.label from __stdin s join region on r_regionkey = s.id where s.label <> 'two'", stdin=b'id,label\n0,"nought, or none"\n2,two\n4,four\n9,nine\n'),
        "SELECT r_name, CASE r_regionkey WHEN 0 THEN 'nought, or none' ELSE 'four' END AS label FROM region WHERE r_regionkey IN (0, 4)",
    ),
    "input_unquoted": (_writing("select k, v from [raw.csv] where k > 1", {"raw.csv": 'k,v\n1,"a\n2,b"\n3,"c"\n'}, in_std="NONE"), "SELECT * FROM (VALUES ('2', 'b\"'), ('3', '\"c\"')) t(k, v)"),
    "output_weak": (
        _writing("select n_nationkey k, n_name + '; ' + n_name pair from nation where n_regionkey = 1", lines=True, out_std="WEAK", out_delim=";"),
        "SELECT 'k;pair' || chr(10) AS line UNION ALL SELECT n_nationkey || ';\"' || n_name || '; ' || n_name || '\"' || chr(10) FROM nation WHERE n_regionkey = 1",
    ),
    "output_all_crlf": (
        _writing("select n_nationkey, n_name + '\"' name from nation where n_regionkey <> 1", lines=True, out_std="ALL", out_delim="|", crlf_output=True, no_header=True),
        "SELECT '\"' || n_nationkey || '\"|\"' || n_name || '\"\"\"' || chr(13) || chr(10) AS line FROM nation WHERE n_regionkey <> 1",
    ),
    "step_to_select": (_writing("select 1 a declare @k int = 3 select n_name from nation where n_regionkey = @k select 2 b", step=2), "SELECT n_name FROM nation WHERE n_regionkey = 3"),
    "imported_variable": (_writing("declare @least int select n_name from nation where n_nationkey > @least", variables={"least": "20"}), "SELECT n_name FROM nation WHERE n_nationkey > 20"),
}

QUERIES: dict[str, Query] = {name: _script(sql) for name, (sql, _) in SCRIPTS.items()} | {name: q for name, (q, _) in WRITERS.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in SCRIPTS.items()} | {name: sql for name, (_, sql) in WRITERS.items() if sql}
