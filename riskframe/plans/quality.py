"""Settings for the validation and ingest queries over the ``v_dirty`` fixture."""

from riskframe.operators.validate import ColumnSetting

# The mapping settings of the dirty extract (import names are v_dirty's columns;
# POLICY_NO is deliberately absent from the data to exercise "Column not found").
DIRTY_SETTINGS = [
    ColumnSetting("CLAIM_ID", "event_id", "Integer", False, "INFO"),
    ColumnSetting("SALES_CHANNEL", "CHANNEL", "Text", False, "INFO"),
    ColumnSetting("GWP", "AMOUNT_TXT", "Double", True, "INFO"),
    ColumnSetting("START_DATE", "DATE_TXT", "Date", True, "INFO"),
    ColumnSetting("REG_NO", "REG_NO", "Text", True, "INFO"),
    ColumnSetting("COVERAGE_ID", "COVERAGE_ID", "Text", False, "INFO"),
    ColumnSetting("POLICY_ID", "POLICY_NO", "Text", False, "INFO"),
]
EXPECTED_COLUMNS = ["event_id", "CHANNEL", "AMOUNT_TXT", "DATE_TXT", "REG_NO", "POLICY_NO"]

# MOF premium settings over v_policy (INFO columns are checked; the GWP template
# makes (POLICY_ID, CERTIFICATE_ID) a unique key).
MOF_GWP_SETTINGS = [
    ColumnSetting("POLICY_ID", "POLICY_ID", "Text", False, "INFO"),
    ColumnSetting("CERTIFICATE_ID", "CERTIFICATE_ID", "Text", True, "INFO"),
    ColumnSetting("START_DATE", "START_DATE", "Date", False, "INFO"),
    ColumnSetting("EXPIRY_DATE", "EXPIRY_DATE", "Date", False, "INFO"),
    ColumnSetting("GWP", "GWP", "Double", False, "INFO"),
    ColumnSetting("VEHICLE_AGE", "VEHICLE_AGE", "Integer", True, "INFO"),
    ColumnSetting("TYPE_VEHICLE", "TYPE_VEHICLE", "Text", False, "VARS"),
    ColumnSetting("COVERAGE_ID", "USAGE_CODE", "Text", False, "INFO"),
]
MOF_GWP_TEMPLATE = "GWP_PNT_11"

# Spellings of plates (a digit follows) that compatibility folding makes valid, or leaves invalid.
PLATE_FORMS = ["３０Ａ１２３４", "𝟑𝟎𝐀𝟏𝟐𝟑", "①②Ⓐ③④⑤", "⑩⒜１２３", "30…A‥123", "№ 12345", "51℡1234", "29㏇12", "㊿B123", "30⒈A12", "Ⅻ1234", "ﬁ1234", "29ｄ－１２３",
               "12㎏345", "30ª123", "½A123", "Å1234", "🄰🄱123", "29\u3000Ａ\u00a0123", "㍘A12", "ⅷ123", "30￣A1"]
