"""Declared schemas of all record kinds; nothing is inferred."""

DOCUMENT = "text string"
POSITION = "`group` string, split string, doc_idx long"
EMBEDDING = f"{POSITION}, embedding array<float>"
FEW_SHOT = "Text string, Instruction string, Output string"
OFFICIAL_MC = "question string, choices array<string>, answer int, topic string"
OFFICIAL_MEDICAL = "question string, opa string, opb string, opc string, opd string, cop int"
OFFICIAL_YES_NO = "question string, answer string"
OFFICIAL_RECIPE = "instruction string, ingredients string, steps string"
OFFICIAL_SUMMARY = "article string, highlights string"
GENERATION = "row_id long, text string, logprobs map<string,double>, choices array<string>"
EVAL_OUTPUT = "instruction string, prediction string, reference string"
PAIRWISE = "row_id long, output_1 string, output_2 string, swapped boolean, model_preference int"
