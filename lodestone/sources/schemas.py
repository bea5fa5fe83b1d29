"""Landing schemas: ordered field names of three all-text files (fixed values; two misspellings are the publisher's)."""

from __future__ import annotations

from pyspark.sql import types as T

COMPLAINTS = "cmplid odino mfr_name maketxt modeltxt yeartxt crash faildate fire injured deaths compdesc city state vin datea ldate miles occurences cdescr cmpl_type police_rpt_yn purch_dt orig_owner_yn anti_brakes_yn cruise_cont_yn num_cyls drive_train fuel_sys fuel_type trans_type veh_speed dot tire_size loc_of_tire tire_fail_type orig_equip_yn manuf_dt seat_type restraint_type dealer_name dealer_tel dealer_city dealer_state dealer_zip prod_type repaired_yn medical_attn vehicles_towed_yn state_of_incident vehicle_operator"
RECALLS = "record_id campno maketxt modeltxt yeartxt mfgcampno compname mfgname bgman endman rcltypecd potaff odate influenced_by mfgtxt rcdate datea rpno fmvss desc_defect conequence_defect corrective_action notes rcl_cmpt_id mfr_comp_name mfr_comp_desc mfr_comp_ptno do_not_drive park_outside"
INVESTIGATIONS = "nhtsa_action_number make model year compname mfr_name odate cdate campno subject summary"


def text_schema(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])
