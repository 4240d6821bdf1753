"""Schemas of the engine's inputs."""

KNOWLEDGE = "id STRING, content STRING, metadata STRUCT<source:STRING, filename:STRING>"
QA = "STRUCT<question:STRING, answer:STRING, explanation:STRING, ann_table_rows:ARRAY<INT>, ann_text_rows:ARRAY<INT>, steps:ARRAY<STRUCT<op:STRING,arg1:STRING,arg2:STRING,res:STRING>>, program:STRING, gold_inds:MAP<STRING,STRING>, exe_ans:DOUBLE, program_re:STRING>"
ANNOTATION = "STRUCT<amt_table:STRING, amt_pre_text:STRING, amt_post_text:STRING, original_program:STRING, step_list:ARRAY<STRING>, answer_list:ARRAY<STRING>, dialogue_break:ARRAY<STRING>, turn_program_ori:ARRAY<STRING>, dialogue_break_ori:ARRAY<STRING>, turn_program:ARRAY<STRING>, qa_split:ARRAY<INT>, exe_ans_list:ARRAY<STRING>>"
DIALOGUE = f"pre_text ARRAY<STRING>, post_text ARRAY<STRING>, filename STRING, table_ori ARRAY<ARRAY<STRING>>, table ARRAY<ARRAY<STRING>>, qa {QA}, id STRING, annotation {ANNOTATION}, context STRING, question STRING"
PREDICTION = "id STRING, output STRING, prediction STRING"
FORMATTED = "id STRING, predicted ARRAY<STRING>"
FINAL = "qa STRUCT<id:STRING, question:STRING, answer:STRING>"
CONVERSATION = "system STRING, conversations ARRAY<STRUCT<role:STRING, content:STRING>>"
EVALUATION = "example_id STRING, results ARRAY<STRUCT<question:STRING, gold_answer:STRING, predicted_answer:STRING, is_correct:BOOLEAN>>, accuracy DOUBLE, correct_count BIGINT, total_turns BIGINT"
EXAMPLE = "id STRING, context STRING, question STRING"
