"""Fixed schemas of instances, events, trajectories and rollout steps."""

TOOL_CALL = "struct<id:string,function:struct<name:string,arguments:string>>"
EVENT = f"kind string, llm_response_id string, role string, content string, prompt_token_ids array<int>, response_token_ids array<int>, tool_calls array<{TOOL_CALL}>"
EVENT_ROW = f"traj_id bigint, pos bigint, {EVENT}"
MESSAGE = "struct<" + ",".join(c.strip().replace(" ", ":", 1) for c in EVENT.split(", ")) + ">"
TRAJECTORY = (
    "instance_id string, target string, total_reward double, reward_dict map<string,double>, final_message string,"
    f" parsed_final_message string, raw_final_message string, messages array<{MESSAGE}>"
)
#: The kind of an event that has none.
UNKNOWN_KIND = "Unknown"
