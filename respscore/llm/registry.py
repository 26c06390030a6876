"""Named queries of the subpackage and their DuckDB SQL."""

from respscore.llm.ball_codes import OP11_SQL, op11_ball_codes
from respscore.llm.collision_count import op3_collision_count
from respscore.llm.cover_dedup import op6_cover_dedup
from respscore.llm.fair_mix import OP4_SQL, op4_fair_mix
from respscore.llm.hyperminhash import op10_hyperminhash
from respscore.llm.license_scan import op9_license_scan
from respscore.llm.neighbour_quality import op7_neighbour_quality
from respscore.llm.output_codes import op12_output_codes
from respscore.llm.packing import op5_packing
from respscore.llm.phrase_tries import OP13_SQL, op13_phrase_tries
from respscore.llm.repair_ids import op2_token_files
from respscore.llm.rule_ledger import OP1_SQL, op1_rule_ledger
from respscore.llm.token_cache import op8_token_counts

QUERIES = {f.__name__: f for f in (op1_rule_ledger, op2_token_files, op3_collision_count, op4_fair_mix, op5_packing, op6_cover_dedup, op8_token_counts,
                                    op7_neighbour_quality, op9_license_scan, op10_hyperminhash, op11_ball_codes,
                                    op12_output_codes, op13_phrase_tries)}
ORACLES = {"op1_rule_ledger": OP1_SQL, "op4_fair_mix": OP4_SQL, "op11_ball_codes": OP11_SQL, "op13_phrase_tries": OP13_SQL}
