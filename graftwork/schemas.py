"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

NODE_PROPOSAL = "proposal_id bigint, batch_id bigint, pos bigint, kind string, granularity string, level int, text string, tags array<string>"
EDGE_PROPOSAL = "proposal_id bigint, batch_id bigint, pos bigint, relation string, from_id string, to_id string, rationale string"
NODES = "id string, kind string, granularity string, level int, text string, tags array<string>, norm_text string, seq bigint, batch_id bigint"
EDGES = "from_id string, to_id string, relation string, rationale string, seq bigint, batch_id bigint"
DECISIONS = "batch_id bigint, pos bigint, accepted boolean, reason string, assigned_id string"
EVENTS = "event_seq bigint, event_type string, id string, kind string, level int, tags array<string>, text string, relation string, from_id string, to_id string, rationale string, reason string, message string"
NODE_PAYLOAD = "struct<nodes:array<struct<kind:string,granularity:string,level:int,text:string,tags:array<string>>>>"
EDGE_PAYLOAD = "struct<edges:array<struct<relation:string,from_id:string,to_id:string,rationale:string>>>"
