"""Input views over the orders table; the text is valid in Spark SQL and DuckDB."""

ATOMS = """
SELECT k AS serial, CONCAT('S', CAST(sid AS VARCHAR(20))) AS structure_id, 1 AS model,
  CASE WHEN k%37=0 THEN 'HETATM' ELSE 'ATOM' END AS record, chain_id,
  CAST(FLOOR(m/8) AS INT)+1 AS res_seq,
  SUBSTR('ALAARGASNASPCYSGLNGLUGLYHISILELEULYSMETPHEPROSERTHRTRPTYRVAL', CAST(3*((7*CAST(FLOOR(m/8) AS BIGINT)+sid+CASE WHEN chain_id='A' THEN 0 ELSE 5 END)%20)+1 AS INT), 3) AS res_name,
  TRIM(SUBSTR('N  CA C  O  CB NZ OD1SG ', CAST(3*(m%8)+1 AS INT), 3)) AS atom_name,
  SUBSTR('NCCOCNOS', CAST(m%8+1 AS INT), 1) AS element, x, y, z
FROM (
  SELECT k, sid, m, CASE WHEN side=0 THEN 'A' ELSE 'B' END AS chain_id,
    CAST(1500*(m%8) + (k*7919)%500 AS DOUBLE)/1000 AS x,
    CAST(1500*(CAST(FLOOR(m/8) AS BIGINT)%8) + (k*104729)%500 AS DOUBLE)/1000 AS y,
    CAST(CASE WHEN side=0 THEN -1500*CAST(FLOOR(m/64) AS BIGINT) ELSE 3000+1500*CAST(FLOOR(m/64) AS BIGINT) END AS DOUBLE)/1000 AS z
  FROM (
    SELECT o_orderkey AS k, CAST(FLOOR(o_orderkey/1000) AS BIGINT) AS sid,
      CAST(FLOOR((o_orderkey%1000)/2) AS BIGINT) AS m, o_orderkey%2 AS side
    FROM orders) b) g
"""

MESH_VERTICES = """
SELECT CAST(FLOOR(o_orderkey/100) AS BIGINT) AS mesh_id, o_orderkey%100 AS vid,
  CAST(o_orderkey%10 AS DOUBLE) AS x, CAST(FLOOR((o_orderkey%100)/10) AS DOUBLE) AS y,
  CAST((o_orderkey*7919)%1000 AS DOUBLE)/2000 AS z
FROM orders
"""

MESH_FACES = """
SELECT mesh_id, 2*v + s AS fid, v AS a,
  CASE WHEN s=0 THEN v+1 ELSE v+11 END AS b, CASE WHEN s=0 THEN v+11 ELSE v+10 END AS c
FROM (SELECT CAST(FLOOR(o_orderkey/100) AS BIGINT) AS mesh_id, o_orderkey%100 AS v FROM orders
      WHERE o_orderkey%10<9 AND o_orderkey%100<90
        AND NOT (FLOOR(o_orderkey/100)%2=0 AND o_orderkey%10=4)) q
CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 AS s) t
"""

CONTACTS = """
SELECT CONCAT('S', CAST(CAST(FLOOR(k/1000) AS BIGINT) AS VARCHAR(20))) AS structure_id,
  CASE WHEN k%3=0 THEN 'A' ELSE 'B' END AS bgn_chain,
  CASE WHEN k%4=0 THEN 'B' ELSE 'A' END AS end_chain,
  CONCAT(CAST(k%63+1 AS VARCHAR(20)), CASE WHEN k%5=0 THEN 'A' ELSE '' END) AS bgn_seq,
  CAST((k*11)%63+1 AS VARCHAR(20)) AS end_seq,
  CASE k%8 WHEN 0 THEN 'ionic' WHEN 1 THEN 'hbond' WHEN 2 THEN 'vdw' WHEN 3 THEN 'pi_pi'
    WHEN 4 THEN 'xbond' WHEN 5 THEN 'polar' WHEN 6 THEN 'proximal' ELSE 'unmapped' END AS raw_type
FROM (SELECT o_orderkey AS k FROM orders) o
"""

VIEWS = {"atoms": ATOMS, "mesh_vertices": MESH_VERTICES, "mesh_faces": MESH_FACES, "contacts": CONTACTS}


def with_views(sql: str, *names: str) -> str:
    """sql with the named views as common table expressions before its own."""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    sql = sql.strip()
    if not names:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql[15:]}"
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"
