"""Names, categories, gates, slots, URLs, log metrics as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of categories and names, in the order in which they are tested.
BOTH_WAYS, ENTRANCE, EXIT = "出入口", "入口", "出口"
WALKWAY, CHECKPOINT, CAR, MAN = "便道", "卡口", "车", "人"
OTHER = "其他"
GATE_PATTERN = "[\u4e00-\u9fa5]{2}(?:东|西|南|北|正|大)?门"
SLOT_RULES = (("摄像头A|车道1-2|车道1·2", "vehA"), ("摄像头B|车道3-4|车道3·4", "vehB"))
SIDES = (("北侧", "北"), ("南侧", "南"), ("东侧", "东"), ("西侧", "西"))
# Metrics of a statistics line.
METRICS = {
    "fps": r"处理fps=([\d.]+)",
    "grab": r"grab帧=(\d+)",
    "sampled": r"采样帧=(\d+)",
    "drop": r"丢帧=(\d+)\(([\d.]+)%\)",
    "busy": r"推理饱和丢帧=(\d+)",
    "shed": r"降载丢帧=(\d+)",
    "outbox_drop": r"outbox丢弃=(\d+)",
    "p95_ms": r"接收至持久化P95=([\d.]+)ms",
    "p99_ms": r"接收至持久化P99=([\d.]+)ms",
    "gap_s": r"最大处理帧间隔=([\d.]+)s",
    "infer_ms": r"推理=([\d.]+)ms/批",
    "batch_size": r"均批=([\d.]+)",
    "batch_wait_ms": r"组批等待=([\d.]+)ms",
    "executor_wait_ms": r"执行器等待=([\d.]+)ms",
    "track_ms": r"跟踪=([\d.]+)ms",
    "receive_to_complete_ms": r"接收至完成=([\d.]+)ms",
    "preprocess_ms": r"预处理=([\d.]+)ms/帧",
    "events": r"事件=(\d+)",
}
# Marks of log lines.
MARKERS = {
    "ffmpeg_fallback": "ffmpeg 解码不可用",
    "fps_mode_unsupported": "Unrecognized option 'fps_mode'",
    "opencv_scale_failed": "解码端缩放未生效",
    "pipeline_start": "管道启动:",
    "pipeline_stop": "管道停止",
    "low_fps": "有效帧率过低",
    "watchdog": "AI 处理异常",
    "wvp_play_failed": "WVP 点播失败",
    "wvp_480": "Temporarily Unavailable",
    "wvp_dns": "WVP 设备列表拉取失败",
    "connected": "视频流已连接",
    "outbox_start": "事件持久队列已启动",
    "outbox_storage_failure": "事件持久化失败",
    "outbox_delivery_failure": "投递失败，将重试",
    "outbox_read_failure": "事件队列存储异常",
    "quarantine": "已隔离，必须人工对账",
    "archive_failure": "MySQL 归档失败",
    "rules_updated": "触发热重载: business_rules.yaml",
}


def normalized(name: Column) -> Column:
    """Identity of a device name: without spaces."""
    return F.replace(F.coalesce(name, F.lit("")), F.lit(" "), F.lit(""))


def first_word(c: Column, words: list[tuple[str, str]]) -> Column:
    """The value of the first word that the text contains, or null."""
    out = None
    for word, value in words:
        out = F.when(F.contains(c, F.lit(word)), value) if out is None else out.when(F.contains(c, F.lit(word)), value)
    return out


def entrance_type(category: Column, both: str = BOTH_WAYS, entry: str = ENTRANCE, exit_: str = EXIT) -> Column:
    """Both-way words contain those of one way, and so come first."""
    return first_word(category, [(both, both), (entry, entry), (exit_, exit_)])


def point_type(category: Column) -> Column:
    return first_word(category, [(WALKWAY, WALKWAY), (CHECKPOINT, CAR + "辆" + CHECKPOINT)])


def camera_type(category: Column) -> Column:
    return first_word(category, [(CHECKPOINT, "vehicle"), (CAR, "vehicle"), (WALKWAY, "person"), (MAN, "person")])


def camera_type_of_name(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(name, F.lit(CAR)) | F.contains(low, F.lit("vehicle")), "vehicle").when(F.contains(name, F.lit(MAN)) | F.contains(low, F.lit("person")), "person")


def gate_key(name: Column, pattern: str = GATE_PATTERN) -> Column:
    return F.regexp_extract(normalized(name), pattern, 0)


def direction(name: Column) -> Column:
    return F.coalesce(first_word(name, [(ENTRANCE, ENTRANCE), (EXIT, EXIT)]), F.lit(OTHER))


def slot(name: Column, category: Column, camera: Column, left_side: Column) -> Column:
    """Slot of a device at its gate: lanes by camera, walkways by side, then by camera type."""
    text = F.concat_ws(" ", name, category)
    side = first_word(text, list(SIDES))
    walk = F.when(side.isNull() | (side == left_side), "per0").otherwise("per1")
    vehicle = (camera == "vehicle") | ((camera.isNull() | ~camera.isin("vehicle", "person")) & text.rlike("摄像头|卡口|车道"))
    lanes = reduce(lambda acc, r: acc.when(text.rlike(r[0]), r[1]), SLOT_RULES[1:], F.when(text.rlike(SLOT_RULES[0][0]), SLOT_RULES[0][1]))
    return lanes.when(text.rlike("便道|人流"), walk).when(F.coalesce(vehicle, F.lit(False)), F.when(F.contains(text, F.lit(EXIT)), "vehB").otherwise("vehA")).otherwise(walk)


def search(query: str, *columns: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower()))


def swap_host(url: Column, host: str) -> Column:
    """The URL at another host, its path and query kept."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*", f"$1{host}")


def play_url(url: Column, hls_base: str) -> Column:
    """RTSP streams are played as HLS under ``hls_base``; others as they are."""
    path = F.regexp_extract(url, r"^rtsp://[^/]*/(.*)$", 1)
    return F.when(url.rlike("^rtsp://"), F.concat(F.lit(hls_base.rstrip("/") + "/"), path, F.lit("/index.m3u8"))).otherwise(url)


def coordinates(text: Column, n: int) -> Column:
    """``n`` numbers of a comma-separated text, or null if it has others."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when((F.size(parts) == n) & ~F.exists(parts, lambda p: p.isNull() | F.isnan(p)), parts)


def metric(message: Column, name: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(message, METRICS[name], group), F.lit("")).cast("double")


def rejections(message: Column, mark: str = " | 拒绝: ") -> Column:
    """Map of reason to count behind the mark."""
    tail = F.when(F.contains(message, F.lit(mark)), F.element_at(F.split(message, mark.replace("|", "\\|")), -1)).otherwise("")
    names = F.regexp_extract_all(tail, F.lit(r"([^\s=]+)=(\d+)"), F.lit(1))
    counts = F.regexp_extract_all(tail, F.lit(r"([^\s=]+)=(\d+)"), F.lit(2))
    return F.map_from_arrays(names, F.transform(counts, lambda c: c.cast("long")))
