"""Lineage-shaped relations derived from the shared tables.

Each is one SELECT that runs unchanged in Spark and in the oracle; ``{name}`` stands for a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: A position that orders the rows of lineitem, the same in both engines.
_POS = "(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT)"

VIEWS = {
    "fx_jobs": """SELECT p_partkey AS job, concat('JOB_', CAST(p_partkey AS STRING)) AS job_name, CASE WHEN p_partkey BETWEEN 1 AND 5 THEN 'RPT' WHEN p_size % 6 = 0 THEN 'MV' WHEN p_size % 6 = 1 THEN 'FCT' WHEN p_size % 6 = 2 THEN 'DIM' WHEN p_size % 6 = 3 THEN 'STG' WHEN p_size % 6 = 4 THEN 'REF' ELSE 'OTHER' END AS category, p_size % 10 = 0 AS is_pass, p_size = 1 AS is_stop, p_brand AS sql_object, p_retailprice AS runtime_sec FROM {part}""",
    "fx_roots": "SELECT concat('RPT_', r_name) AS rpt, CAST(r_regionkey + 1 AS BIGINT) AS root_job FROM {region}",
    "fx_edges": """SELECT DISTINCT job, dependent_job FROM (SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS job, p_partkey AS dependent_job FROM {part} WHERE p_partkey >= 2 UNION ALL SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS job, p_partkey AS dependent_job FROM {part} WHERE p_partkey >= 3) AS u""",
    "fx_edge_log": """SELECT o_orderkey AS pos, o_custkey % 50 AS job, o_orderkey % 7 AS dependent_job, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS cmd, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS params FROM {orders}""",
    "fx_edge_supp": "SELECT o_orderkey AS pos, o_custkey % 60 AS job, o_orderkey % 9 AS dependent_job, o_orderpriority AS cmd FROM {orders} WHERE o_orderkey % 5 = 0",
    "fx_cyclic": "SELECT DISTINCT o_custkey % 40 AS job, (o_custkey % 40 + 1 + o_orderkey % 3 * 13) % 43 AS dependent_job FROM {orders} WHERE o_orderkey % 11 = 0",
    "fx_writes": "SELECT p_partkey AS job, concat('TBL_', CAST(p_partkey % CAST(floor((SELECT count(*) FROM {part}) * 0.7) AS BIGINT) AS STRING)) AS tbl FROM {part}",
    "fx_reads": "SELECT DISTINCT l_partkey AS job, concat('TBL_', CAST(l_orderkey % (SELECT count(*) FROM {part}) AS STRING)) AS tbl FROM {lineitem} WHERE l_linenumber = 1 AND l_quantity <= 8",
    "fx_lineage": f"""SELECT {_POS} AS pos, concat('OBJ_', CAST(l_suppkey AS STRING)) AS object, concat('TBL_', CAST(l_partkey % 40 AS STRING)) AS tgt_table, concat('C', CAST(l_linenumber AS STRING)) AS tgt_col, concat('SRC_', CAST(l_suppkey % 20 AS STRING)) AS src_table, CASE WHEN l_discount = 0 THEN '' ELSE concat('K', CAST(l_orderkey % 6 AS STRING)) END AS src_col, CASE WHEN l_discount = 0 THEN 'Constant / Expression' WHEN l_returnflag = 'A' THEN 'NVL' ELSE 'Direct' END AS transformation, l_suppkey AS job FROM {{lineitem}}""",
    "fx_lineage_alt": f"""SELECT {_POS} AS pos, concat('OBJ_', CAST(l_suppkey + 5 AS STRING)) AS object, concat('ALT_', CAST(l_partkey % 11 AS STRING)) AS tgt_table FROM {{lineitem}} WHERE l_linenumber = 2""",
    "fx_parts": f"""SELECT {_POS} AS pos, concat('OBJ_', CAST(l_suppkey % 30 AS STRING), CASE WHEN l_suppkey % 30 >= 12 OR l_orderkey % 3 = 0 THEN concat('_PART', CAST(l_orderkey % 3 AS STRING)) ELSE '' END) AS object, concat('TBL_', CAST(l_partkey % 9 AS STRING)) AS tgt_table, concat('SRC_', CAST(l_orderkey % 7 AS STRING)) AS src_table FROM {{lineitem}} WHERE l_quantity <= 10""",
    "fx_recs": """SELECT o_orderkey AS pos, CASE o_custkey % 6 WHEN 0 THEN 'A. Redundant Multi-Source Load' WHEN 1 THEN 'B. Pass-Through / Update-in-Place' WHEN 2 THEN 'C. Near-Duplicate Procedures' WHEN 3 THEN 'D. Serial Orchestration Chain (No Data Dep)' WHEN 4 THEN 'E. MV Elimination Candidate' ELSE 'F. LLM-Identified Issues' END AS category, concat('RPT_', CAST(o_custkey % 5 AS STRING)) AS rpt, concat('TBL_', CAST(o_orderkey % 30 AS STRING)) AS target_table, 1 + o_orderkey % 40 AS job_a, 1 + o_custkey % 60 AS job_b, o_orderkey % 4 AS hops, CASE o_orderstatus WHEN 'F' THEN 'LOW' WHEN 'O' THEN 'MEDIUM' ELSE 'HIGH' END AS risk, CAST(floor(o_totalprice / 1000) AS BIGINT) AS est_min FROM {orders}""",
    "fx_runs": "SELECT event_id, ts, user_id % 50 AS job, event_type AS status, value AS runtime_sec, props FROM {events}",
    "fx_scripts": """SELECT p_partkey AS script, concat('#!/bin/ksh\n# Description: load of ', p_name, '\nTABLE_NAME=T_', CAST(p_partkey % 17 AS STRING), '\n', CASE p_size % 5 WHEN 0 THEN concat('sqlplus <<EOF\nINSERT INTO OWN.TGT_', CAST(p_size AS STRING), ' SELECT * FROM OWN.SRC_', CAST(p_partkey % 13 AS STRING), ' a JOIN DUAL ON 1=1 JOIN REF.R_', CAST(p_size AS STRING), ' b ON a.k=b.k;\nEOF') WHEN 1 THEN concat('TRUNCATE TABLE OWN.T_', CAST(p_partkey % 9 AS STRING), ';') WHEN 2 THEN concat('DELETE /*+ parallel */ FROM OWN.D_', CAST(p_size AS STRING), ' WHERE k = 1;\nUPDATE OWN.U_', CAST(p_partkey % 5 AS STRING), ' SET x = 1;') WHEN 3 THEN concat('ssh user@host /opt/jobs/run_', CAST(p_size AS STRING), '.sh arg') ELSE concat('exec PKG_', CAST(p_size AS STRING), '.LOAD_', CAST(p_partkey % 7 AS STRING), '(p);') END) AS body FROM {part}""",
    "fx_packages": """SELECT p_partkey AS script, concat('PKG_', CAST(p_partkey AS STRING)) AS name, concat('CREATE OR REPLACE PACKAGE BODY own.PKG_', CAST(p_partkey AS STRING), ' IS\n c_limit CONSTANT NUMBER := ', CAST(p_size AS STRING), ';\n/* old\nPROCEDURE PRC_OLD IS\nPKG_GRP_COMMON_UTIL.LOG_OLD(1);\n*/\nPROCEDURE PRC_LOAD_', CAST(p_size % 4 AS STRING), ' IS\nBEGIN\n', CASE WHEN p_size % 2 = 0 THEN concat(' BEGIN\n  INSERT /*+ APPEND */ INTO OWN.T_', CAST(p_size AS STRING), ' SELECT * FROM OWN.S_', CAST(p_partkey % 7 AS STRING), '; -- END;\n END;\n') ELSE ' null;\n' END, '  PKG_GRP_COMMON_UTIL.LOG_START("PKG_X.Y;");\nEND PRC_LOAD_', CAST(p_size % 4 AS STRING), ';\n-- PROCEDURE PRC_COMMENTED IS\nPROCEDURE PRC_MERGE_', CAST(p_partkey % 3 AS STRING), ' IS\nBEGIN\n  MERGE INTO OWN.M_', CAST(p_size % 6 AS STRING), ' t USING x ON (t.k = x.k);\n', CASE p_size % 3 WHEN 0 THEN 'EXCEPTION WHEN OTHERS THEN NULL;\n' WHEN 1 THEN concat(' IF LC_SOURCE_CONCEPT = ', chr(39), 'ALL', chr(39), ' OR LC_SOURCE_CONCEPT LIKE ', chr(39), 'PAY', CAST(p_size % 2 AS STRING), '%', chr(39), ' THEN\n  IF x THEN\n   UPDATE own.u SET a = 1;\n  END IF;\n  DELETE FROM own.d;\n END IF;\n') ELSE '' END, 'END;\nPROCEDURE PRC_DEBUG_TRACE IS\nBEGIN NULL;\nEND;\nPROCEDURE MAIN IS\nBEGIN\n  PRC_MERGE_', CAST(p_partkey % 3 AS STRING), '; PRC_LOAD_', CAST(p_size % 4 AS STRING), '(1);\n  -- PKG_OTHER_', CAST(p_size % 3 AS STRING), '.RUN(1);\n', CASE WHEN p_size % 3 = 0 THEN '  PKG_OTHER_0.RUN(1); dbms_stats.gather(1);\n' ELSE '' END, CASE WHEN p_size % 4 = 0 THEN '  UPDATE own.audit_log SET d = 1;\n' ELSE '' END, 'END MAIN;\nEND PKG_', CAST(p_partkey AS STRING), ';\n') AS body FROM {part}""",
    "fx_shell": """SELECT script, replace(body, '~', chr(39)) AS body FROM (SELECT p_partkey AS script, concat('#!/bin/ksh\nv_pkg=$2\nv_from=$', CAST(1 + p_size % 5 AS STRING), '\nsqlplus -s x <<ENDOFSQL\n', CASE p_size % 5 WHEN 0 THEN 'EXECUTE IMMEDIATE ~begin ~ || ~OWN.~ || ~$v_pkg~ || ~.main(1); end;~;\nEXECUTE IMMEDIATE ~begin ~|| ~OWN.~ || ~$v_prc~ || ~;end;~;\n' WHEN 1 THEN concat('EXECUTE IMMEDIATE ~begin own.pkg_', CAST(p_size AS STRING), '~ || ~.load(:a); end;~ USING v_from, v_x;\n') WHEN 2 THEN concat('EXECUTE IMMEDIATE ~BEGIN own.pkg_', CAST(p_size AS STRING), '.main(202502); END;~;\nEXECUTE IMMEDIATE ~begin own.prc_', CAST(p_partkey % 9 AS STRING), '~ || ~($v_from); end;~;\n') WHEN 3 THEN concat('own.PKG_A_', CAST(p_size AS STRING), '.PRC_RUN(1);\nown.PRC_B_', CAST(p_partkey % 5 AS STRING), ';\nPKG_C_', CAST(p_size AS STRING), '.main;\nLOG_TIME(~PKG_Z.main~);\ndbms_output.put_line(~x~);\n') ELSE concat('PRC_D_', CAST(p_size AS STRING), '(1);\nown.$v_pkg(n);\nPKG_E_', CAST(p_partkey % 5 AS STRING), '.PRC_Y(2);\nPRC_Y;\n19.0.0\n') END, 'ENDOFSQL\n') AS body FROM {part}) AS t""",
    "fx_named_writes": """SELECT job, CASE job % 9 WHEN 0 THEN concat(tbl, '_TMP') WHEN 1 THEN concat(tbl, '_BKP') WHEN 2 THEN concat(tbl, '_INTERMEDIATE_X') WHEN 3 THEN concat('FCT_RPT_', tbl) WHEN 4 THEN concat(tbl, '_INTERMEDIATE_EXG') WHEN 5 THEN concat(tbl, ',X_TMP') WHEN 6 THEN concat(tbl, '_JOB_LOG_TMP') WHEN 7 THEN concat('stg_', tbl, '_tmp') ELSE tbl END AS tbl FROM {fx_writes}""",
    "fx_named_reads": """SELECT DISTINCT r.job, w.tbl FROM {fx_reads} r JOIN {fx_named_writes} w ON w.job = 1 + r.job % 90""",
    "fx_summaries": """SELECT p_partkey AS package, replace(replace(concat('<"PROCESS_FLOW": <"steps": "load", "Cursor_use": "OPEN c1; CURSOR c2 IS x ', CASE WHEN p_size % 2 = 0 THEN 'BULK COLLECT INTO v; FORALL i IN 1..n UPDATE t' ELSE 'plain loop' END, CASE WHEN p_size % 4 = 0 THEN '; FORALL j IN v.FIRST..v.LAST /* a comment of more than fifty characters stands here */ UPDATE u' ELSE '' END, '", "bulk": "', CASE WHEN p_size % 3 = 0 THEN 'forall k in a update w' ELSE '' END, '">, "TRANSFORMATION_SUMMARY": <"hardcoded_logic": ', CASE p_size % 6 WHEN 0 THEN '["CASE maps ''A'', ''B'' to groups", "NVL(x, 0) default"]' WHEN 1 THEN '["active_status = ''Y'' filter", <"column": "V_CODE_R (x)", "approx_branch_count": 7>]' WHEN 2 THEN '["decode of ''AA'' ''BB'' ''CC'' ''DD''", "excluded ids not in list"]' WHEN 3 THEN '"large CASE over benefit codes"' WHEN 4 THEN '[<"column": "N_X", "approx_branch_count": 2>, "where code is ''Y'' or ''N'' or ''1'' or ''0'' or ''Q''"]' ELSE '[]' END, '>>'), '<', chr(123)), '>', chr(125)) AS summary FROM {part}""",
    "fx_wide_lineage": """SELECT p_partkey * 100 + n_nationkey AS pos, concat('TBL_', CAST(p_partkey % 3 AS STRING)) AS tgt_table, concat('C', CAST(n_nationkey AS STRING)) AS tgt_col, CAST(floor(p_partkey / 2) AS BIGINT) AS job FROM {part} JOIN {nation} ON n_nationkey <> p_partkey * 7 % 25 AND n_nationkey <> p_size % 25 AND (p_size % 4 <> 0 OR n_nationkey <> p_partkey % 5)""",
    "fx_sql_objects": "SELECT p_partkey AS job, concat('PKG_', CAST(p_size AS STRING), '.LOAD_', CAST(p_partkey % 4 AS STRING)) AS name FROM {part} WHERE p_partkey % 3 <> 0",
    "fx_findings": """SELECT o_orderkey AS pos, CASE o_custkey % 5 WHEN 0 THEN concat('pkg_', CAST(o_custkey % 50 AS STRING), '.load_', CAST(o_custkey % 4 AS STRING), '.sql') WHEN 1 THEN concat('PKG_', CAST(o_custkey % 60 AS STRING), '.sql') WHEN 2 THEN concat('OWN.PKG_', CAST(o_custkey % 50 AS STRING), '.LOAD_', CAST(o_custkey % 4 AS STRING), '_V2.txt') WHEN 3 THEN concat('load_tbl_', CAST(o_custkey % 45 AS STRING), '.sql') ELSE concat('other_', CAST(o_custkey % 9 AS STRING)) END AS script, concat('<"note": "', CASE o_orderkey % 7 WHEN 0 THEN 'Redundant join' WHEN 1 THEN 'Missing filter, wrong key' WHEN 2 THEN 'FULL SCAN without index' WHEN 3 THEN 'plain note' WHEN 4 THEN 'duplicate and slow' WHEN 5 THEN 'Bug' ELSE 'bulk' END, '">') AS finding FROM {orders} WHERE o_orderkey % 3 = 0""",
    "fx_view_names": "SELECT concat(CASE WHEN p_partkey % 3 = 0 THEN 'a_' WHEN p_partkey % 3 = 1 THEN 'VW_' ELSE '' END, 'V', CAST(p_size AS STRING), CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '_VW' END) AS view FROM {part}",
    "fx_view_rows": """SELECT concat('own.', CASE WHEN l_linenumber % 2 = 0 THEN 'A_' ELSE '' END, 'v', CAST(l_suppkey % 60 AS STRING), '_vw@LNK,T2') AS src_table, CASE l_linenumber WHEN 1 THEN concat('PKG_', CAST(l_partkey % 30 AS STRING)) WHEN 2 THEN concat('pkg_', CAST(l_partkey % 30 AS STRING), '.prc') WHEN 3 THEN 'VIEW_X' ELSE NULL END AS package, CASE WHEN l_linenumber = 4 THEN concat('V', CAST(l_suppkey % 60 AS STRING), '_VW') WHEN l_linenumber = 5 THEN ' OBJ ' ELSE '' END AS object FROM {lineitem}""",
    "fx_dependencies": """SELECT concat('S_', CAST(p_partkey % 40 AS STRING), '.sql') AS script, replace(replace(concat('<"INPUT_DEPENDENCIES": <"source_tables": <"views": ["OWN.V', CAST(p_partkey % 55 AS STRING), '_VW", 7], "text": "V9_VW">, "procedure_level_dependencies": ', CASE WHEN p_partkey % 4 = 0 THEN concat('<"p1": ["A_V', CAST(p_size AS STRING), '_VW x"]>') WHEN p_partkey % 4 = 1 THEN 'null' ELSE '["V8_VW"]' END, '>>'), '<', chr(123)), '>', chr(125)) AS summary FROM {part}""",
    "fx_refresh": """SELECT script, replace(body, '~', chr(39)) AS body FROM (SELECT p_partkey AS script, concat('#!/bin/ksh\n', CASE WHEN p_size % 3 = 0 THEN concat('X_MV_NAME=$', CAST(1 + p_size % 4 AS STRING), '\n') WHEN p_size % 3 = 1 THEN concat('MV_NAME = mv_', CAST(p_size AS STRING), '\n') ELSE '' END, 'v_from=$2\nv_to =$', CAST(3 + p_partkey % 3 AS STRING), '\nsqlplus -s x <<EOF\n', CASE p_partkey % 5 WHEN 0 THEN concat('V_MV VARCHAR2(300):=~$MV_NAME~;\ndbms_mview.refresh(V_MV, ~C~);\n') WHEN 1 THEN concat('DBMS_MVIEW.REFRESH ( ~own.mv_', CAST(p_size AS STRING), '~, 1);\n') WHEN 2 THEN 'truncate table own.MV_NAME drop storage;\ndbms_mview.refresh(MV_NAME);\n' WHEN 3 THEN 'dbms_mview.refresh(V_OTHER); execute immediate ~begin x(:a,:b); end;~ USING v_from, v_to, v_none;\n' ELSE concat('EXECUTE IMMEDIATE ~begin y(:a)~\n', CASE WHEN p_size % 2 = 0 THEN '|| ~ $v_from~\n' ELSE '' END, repeat('-- a comment line of forty characters...\n', p_size % 16), 'using in v_to;\nEXECUTE  IMMEDIATE ~commit~;\n') END, 'EOF\n') AS body FROM {part}) AS t""",
    "fx_dispatch": """SELECT script, replace(body, '~', chr(39)) AS body FROM (SELECT p_partkey AS script, concat('PROCEDURE P IS\nBEGIN\n IF UPPER(TRIM(P_TAB)) like ~%t_', CAST(p_size % 5 AS STRING), '%~ THEN\n  INSERT INTO own.a SELECT 1 FROM b; -- END IF\n', CASE p_size % 3 WHEN 0 THEN '  IF x = 1 THEN\n   UPDATE own.u SET a = 1;\n  END IF;\n' WHEN 1 THEN '  IF a THEN IF b THEN c; END IF; END IF;\n' ELSE '' END, CASE WHEN p_partkey % 4 = 0 THEN '  if upper( trim(P_IN)) LIKE ~%INNER%~ THEN\n   DELETE FROM own.d;\n  END IF;\n' ELSE '' END, CASE WHEN p_partkey % 6 = 0 THEN '  IF z THEN\n   y; END IF; END IF; IF w THEN\n' ELSE '' END, ' END IF;\n -- IF UPPER(TRIM(P_TAB)) like ~%NO%~ THEN\n IF UPPER(TRIM(P_TAB)) LIKE ~% second %~ THEN\n  MERGE INTO own.m USING x;\n', CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' END IF; IF UPPER(TRIM(P_TAB)) LIKE ~%SAMELINE%~ THEN\n  null;\n END IF;\n' ELSE ' END IF;\n IF UPPER(TRIM(P_TAB)) LIKE ~%EMPTY%~ THEN\n END IF;\n' END, 'END;\n') AS body FROM {part}) AS t""",
    "fx_statements": "SELECT doc_id AS script, concat('-- Cleaned for lineage: ', source) AS header, replace(coalesce(text, ''), '. ', CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), chr(10)) ELSE concat(';', chr(10), chr(10)) END) AS body FROM {documents}",
    "fx_free_summaries": """SELECT p_partkey AS script, replace(replace(concat('<"name_issue": ["skipped"], "Potential Issues": ', CASE p_size % 6 WHEN 0 THEN '["a", " ", 5, <"detail": "d", "sev": 1>, <"x": 2>, ["deep"]]' WHEN 1 THEN '<"perf": ["p1", <"detail": "q">, null], "note": "text", "blank": " ", "n": 3>' WHEN 2 THEN concat('"plain text ', CAST(p_partkey AS STRING), '"') WHEN 3 THEN '[]' WHEN 4 THEN 'null' ELSE '"  "' END, ', "risk_level": "high", "other": ["no"], "parallel_performance": "skipped"', CASE WHEN p_partkey % 9 = 0 THEN ', "error": "bad"' ELSE '' END, CASE WHEN p_partkey % 11 = 0 THEN ' broken' ELSE '>' END), '<', chr(123)), '>', chr(125)) AS summary FROM {part}""",
    "fx_loads": """SELECT CASE WHEN p_partkey % 60 = 59 THEN 'X_JOB_LOG' ELSE concat('TBL_', CAST(p_partkey % 60 AS STRING)) END AS tbl, CASE WHEN p_partkey % 6 IN (0, 2, 3) OR p_partkey % 12 = 4 THEN concat('J', CASE WHEN CAST(floor(p_partkey / 60) AS BIGINT) % 2 = 0 THEN '_CV_' ELSE '_PACS_' END, CAST(p_partkey AS STRING)) ELSE concat('LOAD-', CAST(p_partkey AS STRING)) END AS job, CASE WHEN p_partkey % 12 = 5 THEN 'a multi_src=1' ELSE NULL END AS params, p_partkey % 29 = 0 AS is_view FROM {part}""",
    "fx_load_objects": """SELECT job, CASE k % 6 WHEN 0 THEN concat('PKG_', CAST(k % 60 AS STRING), '.MAIN') WHEN 1 THEN concat('PKG_', CAST(k % 60 AS STRING), '.MAIN') WHEN 2 THEN concat('PKG_', CAST(k % 60 AS STRING), '.V', CAST(k % 7 AS STRING)) WHEN 3 THEN concat('PKG_', CAST(k % 7 AS STRING), '.MAIN') ELSE concat('PKG_', CAST(k % 11 AS STRING), '.X') END AS object, k % 6 < 2 AND k % 60 <> 12 AS is_parameterised FROM (SELECT DISTINCT job, CAST(regexp_extract(job, '([0-9]+)', 1) AS BIGINT) AS k FROM {fx_loads}) AS j WHERE k % 6 <> 4""",
    "fx_named_in_place": "SELECT job, tbl FROM {fx_named_writes} WHERE job % 3 <> 1 UNION SELECT job, CASE WHEN job % 2 = 0 THEN concat('RPT_', tbl) ELSE concat(tbl, '_gtt') END FROM {fx_writes} WHERE job % 4 = 0",
    "fx_commands": """SELECT o_orderkey AS pos, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'dbms_mview' WHEN 2 THEN '' ELSE concat(' PKG_', CAST(o_custkey % 30 AS STRING)) END AS package, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'v_proc' WHEN 2 THEN '$1' WHEN 3 THEN '(parameter)' WHEN 4 THEN ' ' ELSE concat('PRC_', CAST(o_custkey % 20 AS STRING)) END AS procedure, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat('"PRC_', CAST(o_custkey % 9 AS STRING), '" x') WHEN 3 THEN concat('  MV_', CAST(o_custkey % 9 AS STRING), '   2') WHEN 4 THEN '"open' ELSE concat('PKG_', CAST(o_custkey % 9 AS STRING)) END AS params, CASE o_orderkey % 4 WHEN 0 THEN 'MV_REFRESH' WHEN 1 THEN 'EXECUTE_IMMEDIATE_DYNAMIC' WHEN 2 THEN 'STATIC_SQL' ELSE 'MV_REFRESH_WITH_TRUNCATE' END AS pattern, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' T_1 , T_2' ELSE 'T_3' END AS shell_tables FROM {orders}""",
    "fx_cleaned": """SELECT p_partkey AS object, CASE p_partkey % 9 WHEN 0 THEN repeat(concat('INSERT INTO own.t SELECT a FROM b', chr(10)), 100 + p_size * 8) WHEN 1 THEN concat('BEGIN', chr(10), ' NULL;', chr(10), 'END;', chr(10)) WHEN 2 THEN concat('MERGE INTO own.m', chr(10), 'EXECUTE IMMEDIATE v_sql || x;', chr(10), 'END;') WHEN 3 THEN concat('insert /*+ append */ into own.m', chr(10), 'execute  immediate v_sql ;', chr(10), 'END;') WHEN 4 THEN concat('DELETE FROM d;', chr(10), 'SELECT SYS.XMLType (x), xmlelement(y);', chr(10), 'END;') WHEN 5 THEN concat('-- Lineage: Cursor c', chr(10), 'INSERT INTO a SELECT 1;', chr(10), 'END;', chr(10), 'x') WHEN 6 THEN concat('-- note', chr(10), 'UPDATE t SET a = 1;', chr(10), '  -- END', chr(10), ' ', chr(10), 'END;') WHEN 7 THEN concat('UPDATE own.t SET a = 1;', chr(10), 'a', chr(10), 'b') ELSE concat('INSERT INTO own.t', chr(10), 'SELECT XMLAGG(x)', chr(10), 'FROM b;') END AS body FROM {part}""",
    "fx_dumps": """SELECT p_partkey AS object, replace(replace(CASE p_size % 4 WHEN 0 THEN '<"relationships": [<"id": 1>]>' WHEN 1 THEN concat('<"relationships": [1]>', chr(10), 'Error log: x') WHEN 2 THEN '<"relationships": []>' ELSE 'broken' END, '<', chr(123)), '>', chr(125)) AS dump FROM {part} WHERE p_partkey % 5 = 0""",
    "fx_mixed_scripts": "SELECT script, CASE script % 7 WHEN 0 THEN 'echo done' WHEN 1 THEN concat('SQLPlus -s x', chr(10), 'nothing known') WHEN 2 THEN NULL ELSE body END AS body FROM {fx_scripts}",
    "fx_view_bodies": """SELECT p_partkey AS script, concat('SELECT a, ', CASE WHEN p_partkey % 3 = 0 THEN '(SELECT 1 FROM x union SELECT 2 FROM y)' ELSE 'b' END, chr(10), ' FROM own.t_', CAST(p_size AS STRING), CASE WHEN p_partkey % 4 = 0 THEN concat(chr(10), 'UNION ALL', chr(10), 'SELECT c, REUNION FROM own.u WHERE k IN (SELECT 1 UNION ALL SELECT 2)') ELSE '' END, CASE WHEN p_size % 3 = 0 THEN ' union  SELECT d, e FROM own.v' ELSE '' END, CASE WHEN p_size % 7 = 0 THEN concat(' UNION', chr(10), 'all SELECT f, g FROM own.w') ELSE '' END) AS body FROM {part}""",
    "fx_model_objects": """SELECT DISTINCT object, id, id AS pos, kind, name, parent FROM (
SELECT l_orderkey AS object, concat('T', CAST(l_linenumber AS STRING)) AS id, 'column' AS kind, CASE WHEN l_linenumber = 1 THEN 'sum( a.C1)' WHEN l_linenumber = 2 AND l_orderkey % 3 = 0 THEN 'RS-2' ELSE concat('C', CAST(l_linenumber AS STRING)) END AS name, concat('TBL_', CAST(l_orderkey % 5 AS STRING), CASE WHEN l_orderkey % 11 = 0 THEN '_bkp' ELSE '' END) AS parent FROM {lineitem}
UNION ALL SELECT l_orderkey, concat('F', CAST(l_partkey % 3 AS STRING)), 'other_col', 'x', CASE l_partkey % 3 WHEN 0 THEN 'NVL' WHEN 1 THEN 'RS-1' ELSE 'DECODE' END FROM {lineitem}
UNION ALL SELECT l_orderkey, concat('E', CAST(l_suppkey % 3 AS STRING)), 'other', CASE l_suppkey % 3 WHEN 0 THEN 'CASE' ELSE 'nvl' END, NULL FROM {lineitem} WHERE l_suppkey % 3 < 2
UNION ALL SELECT l_orderkey, concat('S', CAST(CAST(l_quantity AS BIGINT) % 4 AS STRING)), 'column', CASE CAST(l_quantity AS BIGINT) % 4 WHEN 3 THEN 'RelationRows' ELSE concat('K', CAST(CAST(l_quantity AS BIGINT) % 4 AS STRING)) END, concat('SRC_', CAST(CAST(l_quantity AS BIGINT) % 2 AS STRING)) FROM {lineitem}
UNION ALL SELECT l_orderkey, concat('Q', CAST(l_suppkey % 2 AS STRING), '_', CAST(l_linenumber AS STRING)), CASE WHEN l_linenumber = 4 THEN 'column' ELSE 'other_col' END, concat('c', CAST(l_linenumber AS STRING)), concat('Subq', CAST(l_suppkey % 2 AS STRING)) FROM {lineitem}) AS o""",
    "fx_model_relations": """SELECT DISTINCT object, rel, nth, type, target, source, source_col, source_parent FROM (SELECT l_orderkey AS object, CAST(l_linenumber * 10 AS BIGINT) AS rel, l_partkey * 100000 + l_suppkey AS nth, CASE WHEN l_returnflag = 'A' THEN 'fdr' WHEN l_partkey % 17 = 0 THEN 'call' ELSE 'fdd' END AS type, concat('T', CAST(l_linenumber AS STRING)) AS target, concat('F', CAST(l_partkey % 3 AS STRING)) AS source, '' AS source_col, '' AS source_parent FROM {lineitem}
UNION ALL SELECT l_orderkey, CAST(l_linenumber * 10 + 1 AS BIGINT), l_partkey * 100000 + l_suppkey, 'fdd', concat('F', CAST(l_partkey % 3 AS STRING)), concat('E', CAST(l_suppkey % 3 AS STRING)), CASE WHEN l_suppkey % 2 = 0 THEN concat('C', CAST(l_linenumber AS STRING)) ELSE '' END, 'E' FROM {lineitem}
UNION ALL SELECT l_orderkey, CAST(l_linenumber * 10 + 7 AS BIGINT), l_partkey * 100000 + l_suppkey, 'fdd', concat('F', CAST(l_partkey % 3 AS STRING)), concat('S', CAST(CAST(l_quantity AS BIGINT) % 4 AS STRING)), 'k', 'SRC' FROM {lineitem} WHERE l_partkey % 2 = 0
UNION ALL SELECT l_orderkey, CAST(l_linenumber * 10 + 2 AS BIGINT), l_partkey * 100000 + l_suppkey, 'fdd', concat('E', CAST(l_suppkey % 3 AS STRING)), concat('S', CAST(CAST(l_quantity AS BIGINT) % 4 AS STRING)), 'k', 'SRC' FROM {lineitem}
UNION ALL SELECT l_orderkey, CAST(l_linenumber * 10 + 3 AS BIGINT), l_partkey * 100000 + l_suppkey, 'fdd', concat('E', CAST(l_suppkey % 3 AS STRING)), concat('F', CAST(l_partkey % 3 AS STRING)), 'y', 'F' FROM {lineitem} WHERE l_linenumber % 3 = 0
UNION ALL SELECT l_orderkey, CAST(l_linenumber * 10 + 4 AS BIGINT), l_partkey * 100000 + l_suppkey, 'fdd', concat('F', CAST(l_partkey % 3 AS STRING)), 'W', '*', concat('SUBQ', CAST(l_suppkey % 2 AS STRING)) FROM {lineitem} WHERE l_partkey % 4 = 0
UNION ALL SELECT l_orderkey, CAST(l_linenumber * 10 + 5 AS BIGINT), l_partkey * 100000 + l_suppkey, 'fdd', concat('Q', CAST(l_suppkey % 2 AS STRING), '_', CAST(l_linenumber AS STRING)), concat('S', CAST((CAST(l_quantity AS BIGINT) + 1) % 4 AS STRING)), 'k', 'SRC' FROM {lineitem}
UNION ALL SELECT l_orderkey, CAST(l_linenumber * 10 + 6 AS BIGINT), l_partkey * 100000 + l_suppkey, 'fdd', concat('T', CAST(l_linenumber AS STRING)), concat('Q', CAST(l_suppkey % 2 AS STRING), '_', CAST(l_linenumber AS STRING)), '', 'Q' FROM {lineitem} WHERE l_partkey % 7 = 0) AS r""",
}


class Fixtures:
    """``fx["fx_jobs"]`` or ``fx["part"]`` as a DataFrame over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.known:
            if name in BASE:
                self.known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = VIEWS[name]
                self.known[name] = self.spark.sql(sql, **{n: self[n] for n in re.findall(r"\{(\w+)\}", sql)})
        return self.known[name]


def oracle_with(sql: str) -> str:
    """``sql`` with the derived relations that it names as common table expressions."""
    needed = lambda text: {n for n in VIEWS if re.search(rf"\b{n}\b", text)}
    found = needed(sql)
    while more := {n for v in found for n in needed(VIEWS[v])} - found:
        found |= more
    used = [n for n in VIEWS if n in found]
    heads = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in used]
    sql = sql.strip()
    if not heads:
        return sql
    if re.match(r"WITH\s+RECURSIVE\s", sql, re.I):
        return "WITH RECURSIVE " + ", ".join(heads) + ", " + re.sub(r"^WITH\s+RECURSIVE\s+", "", sql, flags=re.I)
    if re.match(r"WITH\s", sql, re.I):
        return "WITH " + ", ".join(heads) + ", " + re.sub(r"^WITH\s+", "", sql, flags=re.I)
    return "WITH " + ", ".join(heads) + " " + sql
