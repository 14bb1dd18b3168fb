"""Record types of the raw files as DDL; missing fields read as null."""

from __future__ import annotations

ACTION = "struct<date:string,chamber:string,action:string>"
VOTE = "struct<bill_number:string,date:string,description:string,chamber:string,yea_votes:array<string>,nay_votes:array<string>,present_votes:array<string>,nv_votes:array<string>,pdf_url:string,vote_type:string>"
SLIP = "struct<name:string,organization:string,representing:string,position:string,hearing_committee:string,hearing_date:string,testimony_type:string,bill_number:string>"

BILL = (
    "bill_number string, leg_id string, description string, chamber string, last_action string, last_action_date string, primary_sponsor string, "
    "synopsis string, status_url string, sponsor_ids array<string>, house_sponsor_ids array<string>, "
    f"action_history array<{ACTION}>, vote_events array<{VOTE}>, witness_slips array<{SLIP}>, full_text string"
)
MEMBER = (
    "id string, name string, member_url string, chamber string, party string, district string, bio_text string, role string, email string, "
    "career_ranges array<struct<start_year:int,end_year:int,chamber:string>>, committees array<string>, "
    "sponsored_bill_ids array<string>, co_sponsor_bill_ids array<string>, offices array<struct<name:string,address:string,phone:string,fax:string>>"
)
COMMITTEE = ("code string, name string, parent_code string, members_list_url string, roster array<struct<member_id:string,member_name:string,role:string>>, bill_numbers array<string>")
VOTE_EVENT = VOTE.removeprefix("struct<").removesuffix(">")
SEATING = ("chamber string, session string, rings array<struct<ring_number:int,name:string,sections:array<struct<label:string,seats:array<string>>>>>")
