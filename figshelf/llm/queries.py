"""The corpus queries and, where SQL can say the same, their DuckDB SQL."""

from figshelf.llm import chat, impact, licences, lines, manifest, mixing, near_duplicates, neighbours, packing, passages, quality, runs, token_files

QUERIES = {"op3_licences": licences.op3_licences, "op6_near_duplicates": near_duplicates.op6_near_duplicates, "op1_neighbours": neighbours.op1_neighbours, "op9_chat": chat.op9_chat, "op8_packing": packing.op8_packing, "op4_mixing": mixing.op4_mixing, "op2_token_files": token_files.op2_token_files, "op5_passage_dedup": passages.op5_passage_dedup, "op7_line_dedup": lines.op7_line_dedup, "op10_quality": quality.op10_quality, "op11_periodic_runs": runs.op11_periodic_runs, "op12_exact_top": impact.op12_exact_top, "op13_manifest": manifest.op13_manifest}
ORACLE_SQL = {"op6_near_duplicates": near_duplicates.OP6_SQL, "op1_neighbours": neighbours.OP1_SQL, "op9_chat": chat.OP9_SQL, "op5_passage_dedup": passages.OP5_SQL, "op7_line_dedup": lines.OP7_SQL, "op10_quality": quality.OP10_SQL, "op11_periodic_runs": runs.OP11_SQL, "op12_exact_top": impact.OP12_SQL, "op13_manifest": manifest.OP13_SQL}
