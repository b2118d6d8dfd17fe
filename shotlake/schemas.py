"""Explicit schemas of the inputs; nothing is inferred."""

MEDIA = """
path string, container string, duration double, size long, width int, height int, fps double, bitrate long,
video_codec string, audio_count int, subtitle_count int, format_start double, video_start double,
video_language string, is_hdr boolean, is_hlg boolean, is_av1 boolean,
color struct<primaries:string,transfer:string,space:string,range:string,pix_fmt:string,bit_depth:int,
             mastering_display:string,max_cll:string>,
dovi struct<present:boolean,profile:int,rpu_present:boolean,el_present:boolean,bl_present:boolean,compatible_id:int>
"""

SIDE_DATA = """struct<side_data_type:string, dv_profile:string, rpu_present_flag:string, rpu_present:string,
el_present_flag:string, el_present:string, bl_present_flag:string, bl_present:string,
dv_bl_signal_compatibility_id:string, compatibility_id:string,
green_x:string, green_y:string, blue_x:string, blue_y:string, red_x:string, red_y:string,
white_point_x:string, white_point_y:string, max_luminance:string, min_luminance:string,
max_content:string, max_average:string>"""

PROBE_JSON = f"""
format struct<format_name:string, duration:string, bit_rate:string, start_time:string, size:string>,
streams array<struct<index:int, codec_type:string, codec_name:string, width:int, height:int, pix_fmt:string,
  color_primaries:string, color_transfer:string, color_space:string, color_range:string, bits_per_raw_sample:string,
  avg_frame_rate:string, r_frame_rate:string, start_time:string, nb_frames:string, duration_ts:string,
  tags:map<string,string>, disposition:map<string,int>, side_data_list:array<{SIDE_DATA}>>>
"""

# one wide row for the three record types of the probe log
PROBE_LOG = """
type string, job string, t double, source string, width int, height int, fps double, duration double,
src_bitrate long, codec string, shots long, frames long, metric string, target double, preset int,
probe_preset int, probing_rate int, probe_max_frames int, probe_grid array<int>, probe_encoder string,
probe_scale string, pix_fmt string, idx int, s0 long, s1 long, pos double, w0 long, w1 long, window long,
whole_shot boolean, svt map<string,double>, crf_star double, qsv map<string,double>, q_star double,
qsv_bpf map<string,double>, seed double, crfs map<string,double>, final map<string,double>, _corrupt string
"""

METRIC_JSON = "pooled_metrics map<string,struct<mean:string>>, aggregateVMAF string"

JOBS = """
id string, source string, title string, preset string, status string, progress double, stage string,
progress_fps double, progress_done long, progress_total long, error string, meta string, params string,
rpu_path string, output_path string, size_before long, size_after long, retries int,
created_at double, started_at double, finished_at double, finalized_at double
"""

JOB_EVENTS = "job_id string, ts timestamp, event string, payload map<string,string>"
LISTING = "path string, size long, mtime timestamp, scan_ts timestamp"
DEVICE_EVENTS = "device string, ts double, kind string, started double"
TAGS_XML = """Tag array<struct<Targets:struct<TrackUID:string,ChapterUID:string,EditionUID:string,AttachmentUID:string,
TargetTypeValue:string>, Simple:array<struct<Name:string,String:string>>>>"""
