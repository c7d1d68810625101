"""Record contracts: the full report record, the feature record, the deny list."""

from __future__ import annotations

from pyspark.sql import types as T

TARGET = "CODRSTAFER"
NUMBER = "NUMLAUDO"

_TYPES = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType()}


def record(text: str) -> T.StructType:
    """Struct from lines ``NAME TYPE [NOT NULL]``, usable without a session."""
    fields = []
    for line in filter(None, (part.strip() for part in text.split(","))):
        name, kind, *rest = line.split()
        fields.append(T.StructField(name, _TYPES[kind], not rest))
    return T.StructType(fields)


# The 83 fields of a full record, in order.
FULL_RECORD = record(
    """
    NUMOSM BIGINT NOT NULL,
    DATAINIAFER STRING NOT NULL,
    DATATERAFER STRING NOT NULL,
    VLRENS_CGA_NMN DOUBLE,
    VLRENS_CGA_CPC DOUBLE,
    VLRENS_CGA_IDU DOUBLE,
    VLRENS_CGA_PQN DOUBLE,
    RESPAFER BIGINT NOT NULL,
    OBSAFER STRING,
    CODPRSERV BIGINT NOT NULL,
    DATALAUDO STRING NOT NULL,
    NUMLAUDO BIGINT NOT NULL,
    DSCMOD STRING NOT NULL,
    CODFORN BIGINT NOT NULL,
    NUMELM BIGINT NOT NULL,
    NUMFASE BIGINT NOT NULL,
    NUMFIO BIGINT NOT NULL,
    TENSAONOM BIGINT NOT NULL,
    TIPOMDR STRING NOT NULL,
    TIPO STRING NOT NULL,
    CODTIP_MED STRING NOT NULL,
    CODLCD_ITC BIGINT NOT NULL,
    VLRDVI_ELM_A DOUBLE,
    VLRDVI_ELM_B DOUBLE,
    VLRDVI_ELM_C DOUBLE,
    DSCRSTAFER STRING NOT NULL,
    VLRLTR BIGINT NOT NULL,
    FTRCRC_CGA_NMN_SER DOUBLE NOT NULL,
    FTRCRC_CGA_NMN_ELM DOUBLE,
    FTRCRC_CGA_IDU DOUBLE NOT NULL,
    FTRCRC_CGA_PQN DOUBLE NOT NULL,
    TPRIFR BIGINT NOT NULL,
    TPRSUP BIGINT NOT NULL,
    FTRCRC_CGA_NMN_SER_1 DOUBLE,
    FTRCRC_CGA_NMN_ELM_1 DOUBLE,
    FTRCRC_CGA_IDU_1 DOUBLE,
    FTRCRC_CGA_PQN_1 DOUBLE,
    TPRIFR_1 DOUBLE,
    TPRSUP_1 DOUBLE,
    USUARIO_AFER STRING NOT NULL,
    CODPRJ DOUBLE,
    ENSAIO_LAUDO_CORR DOUBLE,
    INDRST_ENS_ISP STRING NOT NULL,
    INDRST_ENS_EXD STRING,
    INDRST_ENS_COR DOUBLE,
    INDRST_ENS_MRC STRING NOT NULL,
    INDRST_ENS_TNS DOUBLE,
    INDRST_ENS_EXM STRING NOT NULL,
    INDRST_GER STRING NOT NULL,
    ENSAIO_LAUDO_MESA DOUBLE,
    ENSAIO_LAUDO_TEMPERATURA BIGINT NOT NULL,
    ENSAIO_LAUDO_TEMPERATURA2 BIGINT NOT NULL,
    SIT_LACRE STRING NOT NULL,
    IND_LAUDO_EXTERNO DOUBLE,
    INDRST_ENS_CRP STRING NOT NULL,
    VLRENS_CGA_NMN_1 DOUBLE,
    VLRENS_CGA_CPC_1 DOUBLE,
    VLRENS_CGA_IDU_1 DOUBLE,
    VLRENS_CGA_PQN_1 DOUBLE,
    VLRDVI_ELM_A_1 DOUBLE,
    VLRDVI_ELM_B_1 DOUBLE,
    VLRDVI_ELM_C_1 DOUBLE,
    VLRLTR_1 STRING,
    INDRST_ENS_ISP_1 STRING,
    INDRST_ENS_EXD_1 STRING,
    INDRST_ENS_COR_1 DOUBLE,
    INDRST_ENS_MRC_1 STRING,
    INDRST_ENS_TNS_1 DOUBLE,
    INDRST_ENS_EXM_1 STRING,
    INDRST_GER_1 STRING,
    INDRST_ENS_CRP_1 STRING,
    VLRLTR_MAN_KWH DOUBLE,
    VLRLTR_MAN_KVARH DOUBLE,
    CODFTR_CRC BIGINT NOT NULL,
    CODFTR_CRC_1 DOUBLE,
    DAT_ENVIO_AFERICAO STRING NOT NULL,
    DAT_RETORNO_AFERICAO STRING NOT NULL,
    NUM_INVOLUCRO_EQPTO_MDCAO BIGINT NOT NULL,
    NUM_INVOLUCRO STRING NOT NULL,
    LEITURA_KWH STRING NOT NULL,
    COD_VERIFICADOR_LAUDO STRING,
    LEITURA_KVARH STRING,
    SEQ_NUMLAUDO BIGINT NOT NULL
    """
)

# The fields a model reads.
FEATURE_COLUMNS: tuple[str, ...] = (
    "VLRENS_CGA_IDU",
    "VLRENS_CGA_PQN",
    "NUMLAUDO",
    "DSCMOD",
    "CODFORN",
    "NUMELM",
    "TENSAONOM",
    "TIPOMDR",
    "TIPO",
    "CODTIP_MED",
    "CODLCD_ITC",
    "VLRLTR",
    "FTRCRC_CGA_NMN_SER",
    "USUARIO_AFER",
    "INDRST_ENS_ISP",
    "INDRST_ENS_EXD",
    "INDRST_ENS_MRC",
    "INDRST_ENS_EXM",
    "INDRST_GER",
    "SIT_LACRE",
    "INDRST_ENS_CRP",
    "CODFTR_CRC",
    "NUM_INVOLUCRO_EQPTO_MDCAO",
    "LEITURA_KWH",
)

# Columns never used as features.
DENY_LIST: tuple[str, ...] = (
    "VLRENS_CGA_NMN",
    "VLRENS_CGA_CPC",
    "RESPAFER",
    "CODPRSERV",
    "VLRDVI_ELM_A",
    "VLRDVI_ELM_B",
    "VLRDVI_ELM_C",
    "FTRCRC_CGA_NMN_ELM",
    "TPRIFR",
    "TPRSUP",
    "FTRCRC_CGA_NMN_ELM_1",
    "TPRIFR_1",
    "TPRSUP_1",
    "CODPRJ",
    "ENSAIO_LAUDO_CORR",
    "INDRST_ENS_COR",
    "INDRST_ENS_TNS",
    "ENSAIO_LAUDO_MESA",
    "ENSAIO_LAUDO_TEMPERATURA",
    "ENSAIO_LAUDO_TEMPERATURA2",
    "IND_LAUDO_EXTERNO",
    "VLRENS_CGA_CPC_1",
    "VLRDVI_ELM_B_1",
    "VLRDVI_ELM_C_1",
    "INDRST_ENS_COR_1",
    "INDRST_ENS_TNS_1",
    "VLRLTR_MAN_KWH",
    "VLRLTR_MAN_KVARH",
    "VLR_LTR_MAN_KVARH",
    "SEQ_NUMLAUDO",
)

# Fields shown to a reviewer, and the field with long remarks.
SNAPSHOT_KEYS: tuple[str, ...] = (
    "INDRST_ENS_ISP",
    "INDRST_ENS_EXD",
    "INDRST_ENS_MRC",
    "INDRST_ENS_EXM",
    "INDRST_GER",
    "SIT_LACRE",
    "INDRST_ENS_CRP",
    "OBSAFER",
    "INDRST_ENS_ISP_1",
    "INDRST_ENS_EXD_1",
    "INDRST_ENS_MRC_1",
    "INDRST_ENS_EXM_1",
    "INDRST_GER_1",
    "INDRST_ENS_CRP_1",
)
REMARK_KEY = "OBSAFER"

# Columns of the glossary source.
GLOSSARY_COLUMNS = ("CODRSTAFER", "DSCRSTAFER", "SITRSTAFER")

FEATURE_RECORD = T.StructType([FULL_RECORD[c] for c in FEATURE_COLUMNS])
