"""The fixed words of the industry scorers, written out once more for the checks."""

# Keywords of every domain.
KEYWORDS = {
    "predictive_maintenance": (
        "temperature", "temp", "vibration", "pressure", "rul", "failure", "machine", "sensor", "torque", "rpm",
        "opc", "modbus", "asset", "bearing", "fault",
    ),
    "healthcare": (
        "patient", "bmi", "bp", "blood", "glucose", "heart", "diagnosis", "admit", "ward", "doctor", "hospital",
        "readmission", "cholesterol", "pulse", "spo2", "systolic", "diastolic", "icd",
    ),
    "sales_forecasting": (
        "revenue", "sales", "units", "order", "price", "sku", "customer", "region", "channel", "store", "campaign",
        "discount", "gmv", "asp", "product", "qty",
    ),
    "warehouse_logistics": (
        "warehouse", "sku", "inventory", "stock", "shipment", "delivery", "carrier", "aisle", "bin", "lead_time",
        "defect", "pick", "pack", "supplier", "po",
    ),
    "energy_utilities": (
        "kwh", "mw", "power", "grid", "load", "consumption", "solar", "wind", "frequency", "pf", "transformer",
        "feeder", "demand_mw",
    ),
    "finance_risk": (
        "loan", "credit", "credit_score", "default", "interest", "balance", "emi", "income", "fraud", "transaction",
        "amount", "apr", "collateral", "delinquent",
    ),
    "telecom_churn": (
        "churn", "tenure", "plan", "minutes", "data_usage", "arpu", "subscriber", "complaint", "call_drop", "sim",
        "contract", "monthly_charges",
    ),
    "agriculture_iot": (
        "soil", "moisture", "humidity", "rainfall", "crop", "yield", "ph", "npk", "irrigation", "farm", "nitrogen",
        "pesticide",
    ),
    "hr_people": (
        "employee", "salary", "department", "attrition", "hire", "performance", "manager", "job", "satisfaction",
        "overtime", "hr", "headcount",
    ),
    "education": (
        "student", "grade", "gpa", "marks", "exam", "course", "assignment", "attendance", "school", "university",
        "subject", "credits", "cgpa", "math_score", "reading_score", "writing_score",
    ),
}
# Keywords that no other domain should use.
EXCLUSIVE = {
    "predictive_maintenance": ("vibration", "rul", "torque", "bearing", "modbus", "opc"),
    "healthcare": ("patient", "bmi", "glucose", "readmission", "spo2", "cholesterol", "ward", "hospital", "icd"),
    "sales_forecasting": ("revenue", "sales", "gmv", "sku", "discount", "campaign", "asp"),
    "warehouse_logistics": ("warehouse", "inventory", "shipment", "aisle", "lead_time", "pick"),
    "energy_utilities": ("kwh", "mw", "solar", "wind", "grid", "feeder", "transformer"),
    "finance_risk": ("loan", "credit", "default", "emi", "apr", "fraud", "delinquent"),
    "telecom_churn": ("churn", "arpu", "tenure", "call_drop", "sim", "subscriber"),
    "agriculture_iot": ("soil", "crop", "yield", "npk", "irrigation", "farm"),
    "hr_people": ("employee", "attrition", "salary", "department", "headcount"),
    "education": (
        "student", "gpa", "marks", "exam", "attendance", "assignment", "math_score", "reading_score",
        "writing_score",
    ),
}
# Words that speak against a domain.
AGAINST = {
    "predictive_maintenance": ("patient", "bmi", "churn", "revenue", "sku", "loan", "crop", "arpu"),
    "healthcare": (
        "vibration", "rul", "sku", "churn", "kwh", "modbus", "student", "gpa", "marks", "exam", "attendance",
        "assignment", "course",
    ),
    "sales_forecasting": ("vibration", "patient", "churn", "soil", "modbus", "loan"),
    "warehouse_logistics": ("patient", "vibration", "churn", "bmi", "glucose"),
    "energy_utilities": ("patient", "churn", "bmi", "sku", "vibration", "rul"),
    "finance_risk": ("vibration", "patient", "soil", "modbus", "warehouse", "student", "gpa", "marks", "exam"),
    "telecom_churn": ("vibration", "patient", "bmi", "soil", "rul", "warehouse"),
    "agriculture_iot": ("patient", "churn", "loan", "sku", "modbus", "vibration"),
    "hr_people": ("vibration", "patient", "soil", "modbus", "kwh", "student", "gpa"),
    "education": ("patient", "hospital", "bmi", "glucose", "vibration", "rul", "oee", "modbus"),
}
# Whole words that add 1.5.
BOOSTERS = {
    "sales_forecasting": ("revenue", "sales", "order", "gmv"),
    "healthcare": ("patient", "bmi", "glucose", "hospital"),
    "telecom_churn": ("churn", "arpu", "tenure"),
    "education": ("student", "gpa", "marks", "exam", "attendance"),
}
# The second scorer's strong words.
STRONG = {
    "sales": ("revenue", "sales", "gmv", "order_id", "sku", "customer", "units", "asp"),
    "forecasting": ("forecast", "target", "yhat", "seasonal", "trend", "demand"),
    "churn": ("churn", "churned", "cancelled", "attrition", "is_churn"),
    "predictive_maintenance": ("vibration", "rul", "failure", "fault", "sensor", "bearing", "modbus", "opc"),
    "plant_oee": ("oee", "availability", "downtime", "scrap", "performance"),
    "quality": ("defect", "fpy", "first_pass", "reject", "ncr", "spec_limit", "batch"),
    "education": (
        "student", "gpa", "marks", "exam", "attendance", "assignment", "course", "math_score", "reading_score",
        "writing_score", "cgpa",
    ),
    "health": ("patient", "hospital", "bmi", "glucose", "readmission", "diagnosis", "icd", "ward", "spo2"),
}
# Its weak words.
WEAK = {
    "sales": ("region", "channel", "store", "product", "discount", "quantity"),
    "forecasting": ("date", "period", "week", "month", "qty", "revenue", "actual"),
    "churn": ("tenure", "subscription", "contract", "arpu", "support", "ticket", "complaint"),
    "predictive_maintenance": ("temperature", "pressure", "torque", "rpm", "machine", "asset", "timestamp"),
    "plant_oee": ("asset", "line", "shift", "reject", "planned", "runtime", "good_units"),
    "quality": ("scrap", "quality", "inspection", "ppm", "cpk"),
    "education": ("grade", "school", "university", "subject", "credits"),
    "health": ("age", "weight", "height", "bp", "blood", "pulse"),
}
# Its words against a domain.
PACK_AGAINST = {
    "sales": ("vibration", "rul", "patient", "churn", "downtime", "oee", "student", "gpa"),
    "forecasting": ("vibration", "patient", "churn", "failure", "student"),
    "churn": ("vibration", "revenue", "sku", "oee", "sensor", "student", "gpa"),
    "predictive_maintenance": ("revenue", "sku", "churn", "patient", "order", "student", "gpa"),
    "plant_oee": ("churn", "patient", "revenue", "sku", "student", "gpa"),
    "quality": ("churn", "patient", "revenue", "student", "gpa"),
    "education": ("patient", "hospital", "bmi", "glucose", "readmission", "vibration", "oee", "rul"),
    "health": ("student", "gpa", "marks", "exam", "attendance", "assignment", "course", "sku", "churn"),
}
