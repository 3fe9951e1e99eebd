"""Schemas of segmented pages and of what hangs on them."""

from __future__ import annotations

RECT = "struct<r_x0:double,r_y0:double,r_x1:double,r_y1:double,r_x2:double,r_y2:double,r_x3:double,r_y3:double,coord_origin:string>"
BBOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
RGBA = "struct<r:int,g:int,b:int,a:int>"
SOURCE = "struct<start_time:double,end_time:double,voice:string>"
CELL = f"struct<index:bigint,rgba:{RGBA},rect:{RECT},text:string,orig:string,text_direction:string,confidence:double,from_ocr:boolean,rendering_mode:bigint,widget:boolean,font_key:string,font_name:string,source:{SOURCE}>"
BITMAP = f"struct<index:bigint,rect:{RECT},uri:string,image:struct<mimetype:string,dpi:bigint,size:struct<width:double,height:double>,uri:string>,mode:string>"
WIDGET = f"struct<index:bigint,rect:{RECT},widget_text:string,widget_description:string,widget_field_name:string,widget_field_type:string>"
LINK = f"struct<index:bigint,rect:{RECT},uri:string>"
SHAPE = f"struct<index:bigint,parent_id:bigint,points:array<array<double>>,coord_origin:string,has_graphics_state:boolean,line_width:double,miter_limit:double,line_cap:bigint,line_join:bigint,dash_phase:double,dash_array:array<double>,flatness:double,rgb_stroking:{RGBA},rgb_filling:{RGBA}>"
DIMENSION = f"struct<angle:double,rect:{RECT},boundary_type:string,art_bbox:{BBOX},bleed_bbox:{BBOX},crop_bbox:{BBOX},media_bbox:{BBOX},trim_bbox:{BBOX}>"
PAGE = f"struct<dimension:{DIMENSION},bitmap_resources:array<{BITMAP}>,char_cells:array<{CELL}>,word_cells:array<{CELL}>,textline_cells:array<{CELL}>,has_chars:boolean,has_words:boolean,has_lines:boolean,widgets:array<{WIDGET}>,hyperlinks:array<{LINK}>,lines:array<string>,shapes:array<{SHAPE}>>"
PAYLOAD = f"struct<dimension:{DIMENSION},images:array<{BITMAP}>,cells:array<{CELL}>,shapes:array<{SHAPE}>,widgets:array<{WIDGET}>,hyperlinks:array<{LINK}>>"
ENVELOPE = f"struct<page_number:int,annotations:string,timings:map<string,double>,original:{PAYLOAD},sanitized:{PAYLOAD}>"

ARRAYS = ("bitmap_resources", "char_cells", "word_cells", "textline_cells", "widgets", "hyperlinks", "lines", "shapes")
FLAGS = ("has_chars", "has_words", "has_lines")
REQUIRED = ("dimension", *ARRAYS[:4], *FLAGS, *ARRAYS[4:])
