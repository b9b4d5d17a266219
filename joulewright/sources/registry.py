"""The key registry: every telemetry key and attribute, with its unit, kind and use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# The key catalogue, group by group, in its own order; units in parentheses.
CATALOGUE = """
ICMP ping: reachable, packet_loss_pct (%), rtt_ms (ms)
Host / gateway compute: cpu_usage_pct (%), cpu_iowait_pct (%), cpu_load_avg_1m, cpu_load_avg_5m, cpu_load_avg_15m, cpu_temp_c (°C), memory_usage_pct (%), memory_usage_mb (MB), memory_used_mb (MB), memory_free_mb (MB), swap_used_mb (MB), storage_free_gb (GB), storage_used_gb (GB), storage_health, process_count (count), thread_count (count), uptime_seconds (s), reboot_count_total (count), net_rx_bytes_total (bytes), net_tx_bytes_total (bytes)
Connectivity: cellular_signal_pct (%), cellular_csq, cellular_data_day_mb (MB), cellular_data_month_mb (MB), cellular_sim_active, wlan_signal_pct (%), wlan_signal_level_dbm (dBm), battery_low, child_count (count)
GPS: gps_latitude (°), gps_longitude (°), gps_altitude_m (m), gps_speed_kmh (km/h), gps_course_deg (°), gps_satellite_count (count)
Camera: camera_run_seconds_total (s), channel_online_count (count), ptz_pan_rounds_total (count), ptz_tilt_rounds_total (count), ptz_zoom_steps_total (count), ptz_focus_steps_total (count), ircut_shifts_total (count), heater_state
Access control: online, door_state, alarm, device_time, user_count (count), user_capacity (count), fingerprint_count (count), fingerprint_capacity (count), face_count (count), record_count (count), record_capacity (count)
Fire alarm: fire_alarm_state, fire_pre_alarm_state, fire_acked_state, fire_output_active_state, fire_panel_status, fire_event_code, fire_panel_event_time, smoke_state, ambient_temp_c (°C)
Lift: lift_service_online, lift_service_state_code
Power meter: power_active_kw (kW), power_factor, frequency_hz (Hz), voltage_v (V), voltage_l1_v (V), voltage_l2_v (V), voltage_l3_v (V), current_a (A), current_l1_a (A), current_l2_a (A), current_l3_a (A), energy_active_kwh_total (kWh), energy_reactive_kvarh_total (kvarh)
Chiller: chilled_water_supply_temp_c (°C), chilled_water_return_temp_c (°C), chilled_water_supply_pressure_bar (bar), chilled_water_return_pressure_bar (bar), chiller_load_pct (%), cooling_kw (kW), chiller_state, chiller_state_cmd, runtime_min (min)
Air side: supply_air_temp_c (°C), supply_air_pressure_pa (Pa), fan_speed_pct (%), fan_speed_pct_sp (%), fan_state, fan_state_cmd, damper_state, damper_state_cmd, filter_state, water_valve_state, water_valve_state_cmd, cooling_tower_fan_state, diff_pressure_pa (Pa), air_flow_m3h (m³/h), co2_ppm (ppm), co_ppm (ppm)
Water: pump_speed_pct (%), pump_speed_pct_sp (%), pump_state, pump_state_cmd, pressure_supply_bar (bar), pressure_return_bar (bar), water_supply_temp_c (°C), water_return_temp_c (°C), water_flow_lpm (L/min), water_volume_m3_total (m³), supply_valve_open_limit, supply_valve_close_limit, supply_valve_state_cmd, return_valve_open_limit, return_valve_close_limit, return_valve_state_cmd, bypass_valve_state_cmd, tank_level_low, tank_level_medium, tank_level_high
Shared: fault, mode, state_on_off, state_on_off_cmd, lighting_knx_state, lighting_knx_state_cmd
Plant system: active_energy_kwh (kWh), active_power_kw (kW), chw_return_temp (°C), chw_supply_temp (°C), compressor_status, cooling_load_kw (kW), evaporator_pressure (bar), op_mode, run_hours (h), voltage_l1 (V), voltage_l2 (V), voltage_l3 (V), water_volume_m3 (m³)
Air station: aqi, co (µg/m³), humidity (%), no2 (µg/m³), o3 (µg/m³), pm1 (µg/m³), pm10 (µg/m³), pm25 (µg/m³), pm25_avg (µg/m³), so2 (µg/m³), temperature (°C), wind_speed (m/s)
Attribute: cpu_count, device_label, device_model, device_type, device_type_isapi, firmware_release_date, firmware_version, imei, lift_service_state, mac_address, memory_total_mb, platform, serial_number, storage_capacity_gb, swap_total_mb, vendor_device_id
"""

# One quantity under two names, as source key, canonical key, factor.
KEY_MAP = [
    ("cooling_load_kw", "cooling_kw", 1.0),
    ("chw_supply_temp", "chilled_water_supply_temp_c", 1.0),
    ("chw_return_temp", "chilled_water_return_temp_c", 1.0),
    ("run_hours", "runtime_min", 60.0),
    ("active_energy_kwh", "energy_active_kwh_total", 1.0),
    ("active_power_kw", "power_active_kw", 1.0),
    ("voltage_l1", "voltage_l1_v", 1.0),
    ("voltage_l2", "voltage_l2_v", 1.0),
    ("voltage_l3", "voltage_l3_v", 1.0),
    ("water_volume_m3", "water_volume_m3_total", 1.0),
]

# Which keys of a group each module uses, and as what.
ROLES = """
M1 target: energy_active_kwh_total, power_active_kw, energy_reactive_kvarh_total, active_energy_kwh, active_power_kw
M1 state: power_factor, voltage_l1_v, voltage_l2_v, voltage_l3_v, current_l1_a, current_l2_a, current_l3_a, voltage_v, current_a, frequency_hz
M1 explanatory: lighting_knx_state, state_on_off, temperature, humidity, record_count
M2 target: cooling_kw, cooling_load_kw, active_power_kw, active_energy_kwh
M2 explanatory: chiller_load_pct, chilled_water_supply_temp_c, chilled_water_return_temp_c, chw_supply_temp, chw_return_temp, runtime_min, run_hours, evaporator_pressure, chilled_water_supply_pressure_bar, chilled_water_return_pressure_bar, temperature, humidity, record_count
M2 state: chiller_state, compressor_status, op_mode, cooling_tower_fan_state
M2 command: chiller_state_cmd
M3 target: water_volume_m3_total, water_flow_lpm, power_active_kw, energy_active_kwh_total
M3 explanatory: pump_speed_pct, pressure_supply_bar, pressure_return_bar, water_supply_temp_c, water_return_temp_c
M3 state: pump_state, tank_level_low, tank_level_medium, tank_level_high, supply_valve_open_limit, supply_valve_close_limit, return_valve_open_limit, return_valve_close_limit
M3 command: pump_state_cmd, pump_speed_pct_sp, supply_valve_state_cmd, return_valve_state_cmd, bypass_valve_state_cmd
all quality: reachable, fault, mode
"""

#: Counters that the suffix does not show.
COUNTERS = {"record_count", "active_energy_kwh", "water_volume_m3", "run_hours", "runtime_min", "uptime_seconds"}
TIMES = {"device_time", "fire_panel_event_time"}
#: Physical limits by unit; keys without a unit are states from 0 up.
LIMITS = {"%": (0.0, 100.0), "°C": (-40.0, 120.0), "bar": (0.0, 60.0), "V": (0.0, 1000.0), "Hz": (0.0, 70.0), "kW": (0.0, 1e5), "A": (0.0, 1e4), "L/min": (0.0, 1e6)}


def groups() -> dict[str, list[tuple[str, str | None]]]:
    """Group -> its keys with their units."""
    out = {}
    for line in CATALOGUE.strip().splitlines():
        name, keys = line.split(": ", 1)
        out[name] = [re.fullmatch(r"(\w+)(?: \((.+)\))?", k).groups() for k in keys.split(", ")]
    return out


def roles() -> dict[str, dict[str, str]]:
    """Key -> module -> role."""
    out: dict[str, dict[str, str]] = {}
    for line in ROLES.strip().splitlines():
        what, keys = line.split(": ")
        module, role = what.split()
        for k in keys.split(", "):
            out.setdefault(k, {})[module] = role
    return out


def kind(key: str, unit: str | None) -> str:
    if key.endswith(("_cmd", "_sp")):
        return "command"
    if key in TIMES:
        return "time"
    if key.endswith("_total") or key in COUNTERS:
        return "counter"
    return "gauge" if unit else "state"


SCHEMA = (
    "key string, grp string, source string, unit string, kind string, lo double, hi double, "
    "canonical_key string, factor double, modules array<string>, role string"
)


def rows() -> list[tuple]:
    canon = {k: (c, f) for k, c, f in KEY_MAP}
    used = roles()
    out = []
    for group, keys in groups().items():
        for key, unit in keys:
            k = "attribute" if group == "Attribute" else kind(key, unit)
            lo, hi = LIMITS.get(unit, (0.0, None) if k == "counter" else (None, None))
            to, factor = canon.get(key, (key, 1.0))
            mine = used.get(key, {})
            source = group if group in ("Plant system", "Air station") else "platform"
            out.append((key, group, source, unit, k, lo, hi, to, factor, sorted(mine), next(iter(mine.values()), None)))
    return out


def registry(spark: SparkSession) -> DataFrame:
    """One row per key: its group, source, unit, kind, limits, canonical name and factor, modules and role."""
    return spark.createDataFrame(rows(), SCHEMA)


def may_write(key: str) -> bool:
    """Commands and set points are read, never written."""
    return not key.endswith(("_cmd", "_sp"))
