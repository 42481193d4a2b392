"""Short forms of clinical words and what they stand for."""

#: Short forms in notes: fixed values.
CLINICAL = {
    "t1dm": "type 1 diabetes mellitus", "t2dm": "type 2 diabetes mellitus", "dm": "diabetes mellitus", "dm2": "type 2 diabetes mellitus", "htn": "hypertension", "ckd": "chronic kidney disease",
    "esrd": "end stage renal disease", "aki": "acute kidney injury", "cad": "coronary artery disease", "chf": "congestive heart failure", "hfref": "heart failure with reduced ejection fraction",
    "hfpef": "heart failure with preserved ejection fraction", "chb": "complete heart block", "mi": "myocardial infarction", "stemi": "st elevation myocardial infarction",
    "nstemi": "non st elevation myocardial infarction", "afib": "atrial fibrillation", "af": "atrial fibrillation", "aflutter": "atrial flutter", "svt": "supraventricular tachycardia",
    "vt": "ventricular tachycardia", "vf": "ventricular fibrillation", "pe": "pulmonary embolism", "dvt": "deep vein thrombosis", "vte": "venous thromboembolism",
    "copd": "chronic obstructive pulmonary disease", "ild": "interstitial lung disease", "osa": "obstructive sleep apnea", "ards": "acute respiratory distress syndrome",
    "uri": "upper respiratory infection", "uti": "urinary tract infection", "cap": "community acquired pneumonia", "hap": "hospital acquired pneumonia", "gerd": "gastroesophageal reflux disease",
    "ibd": "inflammatory bowel disease", "ibs": "irritable bowel syndrome", "uc": "ulcerative colitis", "gib": "gastrointestinal bleed", "ugib": "upper gastrointestinal bleed",
    "lgib": "lower gastrointestinal bleed", "cirrhosis": "cirrhosis", "nash": "nonalcoholic steatohepatitis", "nafld": "nonalcoholic fatty liver disease", "cva": "cerebrovascular accident",
    "tia": "transient ischemic attack", "sah": "subarachnoid hemorrhage", "ich": "intracerebral hemorrhage", "ms": "multiple sclerosis", "sz": "seizure", "ra": "rheumatoid arthritis",
    "sle": "systemic lupus erythematosus", "oa": "osteoarthritis", "gout": "gout", "hld": "hyperlipidemia", "dlp": "dyslipidemia", "hypothyroid": "hypothyroidism", "dka": "diabetic ketoacidosis",
    "hhs": "hyperosmolar hyperglycemic state", "dki": "diabetic ketoacidosis", "ods": "osmotic demyelination syndrome", "bph": "benign prostatic hyperplasia", "aaa": "abdominal aortic aneurysm",
    "pad": "peripheral artery disease", "pvd": "peripheral vascular disease", "anemia": "anemia", "ida": "iron deficiency anemia", "sob": "shortness of breath", "doe": "dyspnea on exertion",
    "cp": "chest pain", "abd": "abdominal", "loc": "loss of consciousness", "ams": "altered mental status", "fx": "fracture", "ca": "cancer", "mets": "metastases", "ln": "lymph node",
    "wbc": "white blood cell count", "hgb": "hemoglobin", "hct": "hematocrit", "plt": "platelet count", "cr": "creatinine", "bun": "blood urea nitrogen", "na": "sodium", "k": "potassium",
    "hco3": "bicarbonate", "ldl": "low density lipoprotein", "hdl": "high density lipoprotein", "tg": "triglycerides", "a1c": "hemoglobin a1c", "hba1c": "hemoglobin a1c",
    "bnp": "b type natriuretic peptide", "trop": "troponin", "lfts": "liver function tests", "tsh": "thyroid stimulating hormone", "egfr": "estimated glomerular filtration rate",
    "gfr": "glomerular filtration rate", "bp": "blood pressure", "hr": "heart rate", "rr": "respiratory rate", "ef": "ejection fraction",
}
#: Short forms in imaging orders, which come before those above: fixed values.
IMAGING = {
    "iup": "intrauterine pregnancy", "sbo": "small bowel obstruction", "lbo": "large bowel obstruction", "hape": "high altitude pulmonary edema", "rds": "respiratory distress syndrome",
    "ttn": "transient tachypnea newborn", "ttnb": "transient tachypnea newborn", "cxr": "chest xray", "axr": "abdominal xray", "ptx": "pneumothorax", "htx": "hemothorax", "pna": "pneumonia",
    "nph": "normal pressure hydrocephalus", "avsd": "atrioventricular septal defect", "vsd": "ventricular septal defect", "asd": "atrial septal defect", "chd": "congenital heart disease",
    "pvr": "post void residual", "mvc": "motor vehicle collision", "mva": "motor vehicle accident", "lle": "left lower extremity", "rle": "right lower extremity", "lue": "left upper extremity",
    "rue": "right upper extremity", "ue": "upper extremity", "le": "lower extremity", "ipf": "idiopathic pulmonary fibrosis", "nsclc": "non small cell lung cancer",
    "gtd": "gestational trophoblastic disease", "ttts": "twin twin transfusion syndrome", "iugr": "intrauterine growth restriction", "sdh": "subdural hematoma", "edh": "epidural hematoma",
    "goo": "gastric outlet obstruction", "pud": "peptic ulcer disease", "lad": "lymphadenopathy", "hf": "heart failure", "phtn": "pulmonary hypertension", "hx": "history", "eval": "evaluate",
    "dx": "diagnosis", "pt": "patient", "sx": "symptoms", "ctap": "ct abdomen pelvis", "postvoid": "post void", "intraabdominal": "intra abdominal", "sao2": "oxygen saturation", "hgb": "hemoglobin",
    "etoh": "alcohol", "cnh": "", "abd": "abdominal", "r": "right", "l": "left",
}
#: Slashed forms, which are replaced in this order wherever they stand: fixed values.
SLASHED = {"r/o": "rule out", "s/p": "status post", "f/u": "follow up", "h/o": "history of", "s/o": "setting of", "w/": "with", "n/v": "nausea vomiting", "c/f": "concern for"}
