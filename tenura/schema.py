"""Column names, domains and label lists shared by every operator.

Everything below is a fixed value: the names, edges and labels must equal the
ones analysts already use for results to match.
"""

from __future__ import annotations

from pyspark.sql import types as T

CUSTOMER_ID = "customerID"
TARGET = "Churn"
TARGET_FLAG = "Churn_Flag"
TARGET_VALUES = ["Yes", "No"]
RANDOM_SEED = 42

_TEXT, _INT, _DOUBLE = T.StringType(), T.IntegerType(), T.DoubleType()

RAW_SCHEMA = T.StructType([
    T.StructField("customerID", _TEXT),
    T.StructField("gender", _TEXT),
    T.StructField("SeniorCitizen", _INT),
    T.StructField("Partner", _TEXT),
    T.StructField("Dependents", _TEXT),
    T.StructField("tenure", _INT),
    T.StructField("PhoneService", _TEXT),
    T.StructField("MultipleLines", _TEXT),
    T.StructField("InternetService", _TEXT),
    T.StructField("OnlineSecurity", _TEXT),
    T.StructField("OnlineBackup", _TEXT),
    T.StructField("DeviceProtection", _TEXT),
    T.StructField("TechSupport", _TEXT),
    T.StructField("StreamingTV", _TEXT),
    T.StructField("StreamingMovies", _TEXT),
    T.StructField("Contract", _TEXT),
    T.StructField("PaperlessBilling", _TEXT),
    T.StructField("PaymentMethod", _TEXT),
    T.StructField("MonthlyCharges", _DOUBLE),
    T.StructField("TotalCharges", _TEXT),
    T.StructField("Churn", _TEXT),
])
RAW_COLUMNS = RAW_SCHEMA.names

# Columns coerced to numbers while cleaning, with the type they become.
NUMERIC_COERCIONS = {
    "TotalCharges": "double",
    "MonthlyCharges": "double",
    "tenure": "int",
    "SeniorCitizen": "int",
}

# Bins: (edges, labels); each bin is open on the left and closed on the right.
_INF = float("inf")
BINS = {
    "Tenure_Group": (
        "tenure",
        [-1, 12, 24, 36, 48, 60, 72],
        ["0-12", "13-24", "25-36", "37-48", "49-60", "61-72"],
    ),
    "MonthlyCharge_Group": (
        "MonthlyCharges",
        [-_INF, 35, 60, 90, 120, _INF],
        ["<=35", "36-60", "61-90", "91-120", ">120"],
    ),
    "Tenure_Segment": ("tenure", [-1, 12, 36, 72], ["New", "Mid-Tenure", "Long-Term"]),
    "Charge_Segment": (
        "MonthlyCharges",
        [-_INF, 50, 90, _INF],
        ["Low Charge", "Medium Charge", "High Charge"],
    ),
}
VALUE_BANDS = ["Low", "Medium", "High", "Very High"]
RISK_LABELS = [
    "High Risk: New + High Charge",
    "Medium Risk: New + Lower Charge",
    "Potential Risk: Existing + High Charge",
]
RISK_DEFAULT = "Lower Observed Risk"

# Columns whose "Yes" answers are counted.
COUNTED_SERVICES = {
    "Service_Count": [
        "PhoneService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
        "TechSupport", "StreamingTV", "StreamingMovies",
    ],
    "Support_Count": ["OnlineSecurity", "TechSupport"],
    "Streaming_Count": ["StreamingTV", "StreamingMovies"],
}
# 0/1 flag column -> (source column, value that sets the flag).
EQUALITY_FLAGS = {
    "Is_Month_To_Month": ("Contract", "Month-to-month"),
    "Has_Partner": ("Partner", "Yes"),
    "Has_Dependents": ("Dependents", "Yes"),
    "Paperless_Flag": ("PaperlessBilling", "Yes"),
    "Electronic_Check_Flag": ("PaymentMethod", "Electronic check"),
}

# Label order of the ordered categories; empty labels are reported too.
CATEGORY_LABELS = {
    **{name: labels for name, (_, _, labels) in BINS.items()},
    "Customer_Value_Band": VALUE_BANDS,
}

SEGMENT_DIMS = [
    "Contract", "Tenure_Group", "MonthlyCharge_Group", "PaymentMethod", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "PhoneService", "MultipleLines", "PaperlessBilling", "Partner",
    "Dependents", "gender", "SeniorCitizen_Label", "Customer_Value_Band", "Service_Count",
]
SUMMARY_DIMS = ["Tenure_Segment", "Charge_Segment", "Risk_Segment", "Customer_Value_Band"]
BUSINESS_DIMS = [
    "Contract", "PaymentMethod", "InternetService", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "PaperlessBilling",
    "Partner", "Dependents", "gender", "SeniorCitizen_Label", "Tenure_Segment",
    "Charge_Segment", "Risk_Segment",
]
METRIC_DIMS = [
    "Contract", "PaymentMethod", "InternetService", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "PhoneService",
    "MultipleLines", "PaperlessBilling", "Partner", "Dependents", "gender",
    "SeniorCitizen_Label", "Tenure_Group", "MonthlyCharge_Group", "Customer_Value_Band",
    "Tenure_Segment", "Charge_Segment", "Risk_Segment",
]
CHI_SQUARE_DIMS = [
    "Contract", "Tenure_Group", "MonthlyCharge_Group", "PaymentMethod", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "PhoneService", "MultipleLines", "PaperlessBilling", "Partner",
    "Dependents", "gender", "SeniorCitizen_Label",
]
EDA_DIMS = [
    "Contract", "Tenure_Group", "PaymentMethod", "InternetService", "OnlineSecurity",
    "TechSupport", "PaperlessBilling", "SeniorCitizen_Label", "Partner", "Dependents",
    "gender", "MonthlyCharge_Group", "Customer_Value_Band",
]
SLICERS = ["Partner", "Contract", "gender"]

METRICS = [
    "MonthlyCharges", "TotalCharges", "tenure", "Annual_Revenue", "Revenue_Lost",
    "Estimated_LTV", "Service_Count", "Support_Count", "Streaming_Count",
]
TEST_FEATURES = ["MonthlyCharges", "TotalCharges", "tenure", "Estimated_LTV", "Service_Count"]
OUTLIER_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges", "Estimated_LTV"]
CLUSTER_FEATURES = [
    "tenure", "MonthlyCharges", "TotalCharges", "Service_Count", "Support_Count",
    "Streaming_Count",
]
CORRELATION_COLUMNS = [
    "SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "Churn_Flag", "Tenure_Year",
    "Annual_Revenue", "Revenue_Lost", "Estimated_LTV", "Service_Count", "Support_Count",
    "Streaming_Count", "Is_Month_To_Month", "Has_Partner", "Has_Dependents", "Paperless_Flag",
    "Electronic_Check_Flag",
]
# Left out of model training: identifiers, the target, and what leaks it.
ML_EXCLUDED = [
    "customerID", "Churn", "Churn_Flag", "Revenue_Lost", "Annual_Revenue", "Estimated_LTV",
    "Customer_Value_Band", "Tenure_Group", "MonthlyCharge_Group", "SeniorCitizen_Label",
]
