"""Insurance-shaped inputs derived from the driver's TPC-H-like tables.

The SQL texts below are used verbatim on both sides: Spark runs them through ``spark.sql`` with the
base tables passed as DataFrame arguments (no global temp views), and the DuckDB oracle inlines
them as CTEs (``oracle_with``). Base tables are read with ``spark.read.parquet`` so projection and
filters reach the Parquet scan.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# The derived-view definitions (FIXTURES.md §2) and the small reference tables.
VIEW_SQL: dict[str, str] = {
    "v_policy": """
SELECT CAST(o_orderkey AS STRING) AS POLICY_ID, CAST(o_custkey AS STRING) AS CERTIFICATE_ID,
  CAST(o_orderdate AS DATE) AS START_DATE,
  CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 1100 AS INT) AS EXPIRY_DATE,
  CAST(o_totalprice AS DECIMAL(20,4)) AS GWP,
  CAST(o_totalprice AS DECIMAL(20,4)) * 4000 AS VEHICLE_VALUE,
  CAST(o_orderkey % 25 AS INT) AS VEHICLE_AGE, CAST(4 + o_orderkey % 12 AS INT) AS VEHICLE_SEATS,
  o_orderpriority AS TYPE_VEHICLE, o_orderstatus AS USAGE_CODE, c_mktsegment AS PROVINCE
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "v_claim": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS CLAIM_ID,
  CAST(l_orderkey AS STRING) AS POLICY_ID, CAST(o_custkey AS STRING) AS CERTIFICATE_ID,
  CAST(l_shipdate AS DATE) AS OCCURENCE_DATE,
  CAST(CAST(l_extendedprice AS DECIMAL(20,4)) * (CAST(l_discount AS DECIMAL(4,2)) - CAST(0.02 AS DECIMAL(4,2))) AS DECIMAL(20,4)) AS CLAIM_PMT
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # claims of policies that no extract holds, beside the others
    "v_claim_ext": """
SELECT CLAIM_ID, CASE WHEN CLAIM_ID LIKE '%1-1-%' OR CLAIM_ID LIKE '%7-2-%' THEN concat('U', POLICY_ID) ELSE POLICY_ID END AS POLICY_ID,
  CERTIFICATE_ID, OCCURENCE_DATE, CLAIM_PMT FROM {v_claim}""",
    # a third of all claims belong to one policy
    "v_claim_hot": """
SELECT CLAIM_ID, CASE WHEN CLAIM_ID LIKE '%1-_-%' OR CLAIM_ID LIKE '%4-_-%' OR CLAIM_ID LIKE '%7-_-%' THEN (SELECT min_by(POLICY_ID, CAST(POLICY_ID AS BIGINT)) FROM {v_policy} WHERE year(START_DATE) = 1994 AND year(EXPIRY_DATE) = 1996) ELSE POLICY_ID END AS POLICY_ID,
  CASE WHEN CLAIM_ID LIKE '%1-_-%' OR CLAIM_ID LIKE '%4-_-%' OR CLAIM_ID LIKE '%7-_-%' THEN (SELECT min_by(CERTIFICATE_ID, CAST(POLICY_ID AS BIGINT)) FROM {v_policy} WHERE year(START_DATE) = 1994 AND year(EXPIRY_DATE) = 1996) ELSE CERTIFICATE_ID END AS CERTIFICATE_ID, OCCURENCE_DATE, CLAIM_PMT
FROM {v_claim}""",
    "v_account": """
SELECT * FROM (VALUES (0,'1111','111','110','00'),(1,'1121','112','110','00'),(2,'1131','113','120','00'),(3,'1311','131','130','00'),(4,'2111','211','220','00'),(5,'3311','331','310','00'),(6,'3341','334','320','00'),(7,'4111','411','410','00'),(8,'4211','421','420','00'),(9,'5111','511','420','01'),(10,'5151','515','420','02'),(11,'6321','632','420','11'),(12,'6421','642','420','12'),(13,'911','911','420','00')) AS t(idx, code, accountSM, accountBS, accountPL)""",
    "v_journal": """
SELECT CAST(l_shipdate AS DATE) AS INVOICE_DATE, CAST(l_suppkey % 14 AS INT) AS a, CAST(l_partkey % 14 AS INT) AS b, CAST(l_extendedprice AS DECIMAL(20,4)) AS amt
FROM {lineitem}""",
    "v_gl": """
SELECT INVOICE_DATE, x.code AS DEBIT_ACC, y.code AS CREDIT_ACC, amt AS DEBIT_AMT, CAST(0 AS DECIMAL(20,4)) AS CREDIT_AMT FROM {v_journal} JOIN {v_account} x ON a = x.idx JOIN {v_account} y ON b = y.idx
UNION ALL
SELECT INVOICE_DATE, y.code, x.code, CAST(0 AS DECIMAL(20,4)), amt FROM {v_journal} JOIN {v_account} x ON a = x.idx JOIN {v_account} y ON b = y.idx""",
    # MOF inputs: USAGE_CODE stands for COVERAGE_ID, the customer for the registration number
    "v_mof_premium": """
SELECT POLICY_ID, USAGE_CODE AS COVERAGE_ID, TYPE_VEHICLE, VEHICLE_AGE, CERTIFICATE_ID AS REG_NO, VEHICLE_VALUE, GWP FROM {v_policy}""",
    "v_mof_claim": """
SELECT c.CLAIM_ID, c.POLICY_ID, p.USAGE_CODE AS COVERAGE_ID, p.TYPE_VEHICLE, p.VEHICLE_AGE, c.CLAIM_PMT FROM {v_claim} c JOIN {v_policy} p ON c.POLICY_ID = p.POLICY_ID""",
    "v_reserve": """
SELECT POLICY_ID, TYPE_VEHICLE, USAGE_CODE, VEHICLE_AGE,
  CAST(GWP * CAST(0.40 AS DECIMAL(4,2)) AS DECIMAL(20,4)) AS UPR_END, CAST(GWP * CAST(0.10 AS DECIMAL(4,2)) AS DECIMAL(20,4)) AS OSC_END, CAST(GWP * CAST(0.05 AS DECIMAL(4,2)) AS DECIMAL(20,4)) AS LARC_RES_END,
  CAST(GWP * CAST(0.30 AS DECIMAL(4,2)) AS DECIMAL(20,4)) AS UPR_BEG, CAST(GWP * CAST(0.12 AS DECIMAL(4,2)) AS DECIMAL(20,4)) AS OSC_BEG, CAST(GWP * CAST(0.04 AS DECIMAL(4,2)) AS DECIMAL(20,4)) AS LARC_RES_BEG
FROM {v_policy}""",
    "v_dirty": """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'Unknown' ELSE event_type END AS CHANNEL,
  CASE WHEN event_id % 5 = 0 THEN concat(CAST(CAST(value AS DECIMAL(12,2)) AS STRING), 'x') WHEN event_id % 13 = 0 THEN '' ELSE CAST(CAST(value AS DECIMAL(12,2)) AS STRING) END AS AMOUNT_TXT,
  CASE WHEN event_id % 3 = 0 THEN '31/12/2019' WHEN event_id % 3 = 1 THEN '2019-12-31' ELSE 'n/a' END AS DATE_TXT,
  CASE WHEN event_id % 4 = 0 THEN concat('30a-', CAST(10000 + event_id % 89999 AS STRING)) WHEN event_id % 4 = 1 THEN concat('51 L D ', CAST(10000 + event_id % 89999 AS STRING)) WHEN event_id % 4 = 2 THEN concat(CAST(10000 + event_id % 89999 AS STRING), 'NG01') ELSE '??' END AS REG_NO,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS STRING) ELSE concat('0', CAST(event_id AS STRING)) END AS COVERAGE_ID
FROM {events}""",
    # Statement templates: (lineCode, code, isTotalLine, calculationFormula) plus display columns.
    "t_bs": """
SELECT lineCode, concat('BS ', code) AS lineName, code, '' AS noteRef, isTotalLine, calculationFormula FROM (VALUES (1,'100','TRUE','[110]+[120]+[130]'),(2,'110','FALSE',''),(3,'120','FALSE',''),(4,'130','FALSE',''),(5,'200','TRUE','[220]'),(6,'220','FALSE',''),(7,'270','TRUE','[100]+[200]'),(8,'300','TRUE','[310]+[320]'),(9,'310','FALSE',''),(10,'320','FALSE',''),(11,'400','TRUE','[410]+[420]'),(12,'410','FALSE',''),(13,'420','FALSE',''),(14,'440','TRUE','[300]+[400]')) AS t(lineCode, code, isTotalLine, calculationFormula)""",
    "t_pl01": """
SELECT lineCode, concat('PL ', code) AS lineName, code, '' AS noteRef, isTotalLine, calculationFormula FROM (VALUES (1,'01','FALSE','PhatSinhCO'),(2,'02','FALSE','PhatSinhCO'),(3,'10','TRUE','[01]+[02]'),(4,'11','FALSE','PhatSinhNO'),(5,'12','FALSE','-PhatSinhNO'),(6,'20','TRUE','[11]+(12)'),(7,'50','TRUE','[10]–[20]'),(8,'60','TRUE','[70]'),(9,'70','TRUE','[50]')) AS t(lineCode, code, isTotalLine, calculationFormula)""",
    "t_pl02": """
SELECT lineCode, concat('PL2 ', code) AS lineName, code, '' AS noteRef, isTotalLine, calculationFormula FROM (VALUES (1,'1','FALSE','[50]'),(2,'2','FALSE','[10]-[20]'),(3,'3','TRUE','[1]+[2]')) AS t(lineCode, code, isTotalLine, calculationFormula)""",
    "t_cf01": """
SELECT lineCode, concat('CF ', code) AS lineName, code, '' AS noteRef, isTotalLine, calculationFormula FROM (VALUES (1,'01','FALSE','PhatSinhNO(11/131)'),(2,'02','FALSE','PhatSinhCO(11/331)'),(3,'03','FALSE','PhatSinhNO(11/511)-PhatSinhNO(11/515)'),(4,'20','TRUE','[01]+[02]+[03]')) AS t(lineCode, code, isTotalLine, calculationFormula)""",
    "t_cf02": """
SELECT lineCode, concat('CF2 ', code) AS lineName, code, '' AS noteRef, isTotalLine, calculationFormula FROM (VALUES (1,'01','FALSE','PL(50)'),(2,'02','FALSE','PhatSinhCO(11/334)'),(3,'20','TRUE','[01]+[02]')) AS t(lineCode, code, isTotalLine, calculationFormula)""",
    "t_duno": """
SELECT lineCode, concat('BS ', code) AS lineName, code, '' AS noteRef, isTotalLine, calculationFormula FROM (VALUES (1,'900','FALSE','DUNO(130)-DUCO(310)'),(2,'901','FALSE','DUNO(110)+DUNO(120)'),(3,'902','FALSE','-DUCO(420)')) AS t(lineCode, code, isTotalLine, calculationFormula)""",
    # PNT-11 code mappings: USAGE_CODE stands for COVERAGE_ID, order priority for vehicle type;
    # one value of each is left unmapped on purpose.
    "m_coverage": """
SELECT * FROM (VALUES ('F','0101','Bao hiem TNDS'),('O','0102','Bao hiem vat chat xe')) AS t(cols, PROD_MOF_CODE, PROD_MOF_NAME)""",
    "m_vehicle": """
SELECT * FROM (VALUES ('1-URGENT','01','Xe cho nguoi','0101','Duoi 6 cho'),('2-HIGH','01','Xe cho nguoi','0102','Tu 6 den 11 cho'),('3-MEDIUM','02','Xe cho hang','0201','Duoi 3 tan'),('4-NOT SPECIFIED','03','Mo to','0301','Tat ca')) AS t(cols, PNT_11_CODE, PNT_11_NAME, SUB_PNT_11_CODE, SUB_PNT_11_NAME)""",
}

# The same rows as VIEW_SQL's text, read from one scan of the journal (the oracle keeps the union).
SPARK_VIEW_SQL: dict[str, str] = {
    "v_gl": """
SELECT INVOICE_DATE, DEBIT_ACC, CREDIT_ACC, DEBIT_AMT, CREDIT_AMT
FROM (SELECT INVOICE_DATE, x.code AS p, y.code AS q, amt, CAST(0 AS DECIMAL(20,4)) AS nil FROM {v_journal} JOIN {v_account} x ON a = x.idx JOIN {v_account} y ON b = y.idx)
LATERAL VIEW inline(array(named_struct('d', p, 'c', q, 'x', amt, 'y', nil), named_struct('d', q, 'c', p, 'x', nil, 'y', amt))) s AS DEBIT_ACC, CREDIT_ACC, DEBIT_AMT, CREDIT_AMT""",
}

_PLACEHOLDER = re.compile(r"\{([a-z_0-9]+)\}")


def spread(df: DataFrame) -> DataFrame:
    """For benchmarks of one-file tables only (``spark.riskframe.spread``): deal a scan's rows to all
    cores. Off by default; a table's own splits hold."""
    if df.sparkSession.conf.get("spark.riskframe.spread", "false") != "true":
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def dependencies(name: str) -> list[str]:
    return list(dict.fromkeys(_PLACEHOLDER.findall(VIEW_SQL[name])))


class Fixtures:
    """Lazily built DataFrames for the base tables of one scale-factor folder and the derived views.

    DataFrames are immutable plans, so one set per (session, folder) is shared by every query:
    footers are read and scans are sized once, not once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        # the cache lives on the session object, so it never outlives (or crosses) sessions
        shared = getattr(spark, "_riskframe_fixtures", None)
        if shared is None:
            shared = {}
            spark._riskframe_fixtures = shared
        self._cache = shared.setdefault(self.sf_dir, {})

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEW_SQL:
                args = {dep: self.table(dep) for dep in dependencies(name)}
                self._cache[name] = self.spark.sql(SPARK_VIEW_SQL.get(name, VIEW_SQL[name]), **args)
            else:
                self._cache[name] = spread(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
        return self._cache[name]

    __getitem__ = table


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n not in VIEW_SQL:
            return
        for d in dependencies(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


@lru_cache(maxsize=None)
def _duck_body(name: str) -> str:
    return _PLACEHOLDER.sub(lambda m: m.group(1), VIEW_SQL[name]).strip()


def oracle_with(*names: str) -> str:
    """``WITH`` clause defining the named derived views (and what they use) for DuckDB."""
    parts = [f"{n} AS ({_duck_body(n)})" for n in _closure(list(names))]
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""
