"""Fixed names and values of missions, profiles and their features."""

from __future__ import annotations

# Column names in their pinned order.
RAW_FEATURES = """
sim_duration_steps sim_policy_frequency uav_type uav_mass_kg uav_battery_wh uav_fuel_l uav_energy_source
uav_max_speed_mps uav_max_tilt_deg uav_reserve_fraction uav_battery_model_hover_power_w uav_battery_model_k_drag
uav_battery_model_k_manoeuvre uav_rotorcraft_rotor_count uav_rotorcraft_disk_area_m2 uav_sensors_gnss
uav_sensors_lidar uav_sensors_radar uav_sensors_camera_rgb uav_sensors_camera_thermal uav_payload_mass_kg
uav_payload_drag_coeff environment_airspace environment_weather_wind_mps environment_weather_wind_dir_deg
environment_weather_gust_mps environment_weather_visibility environment_weather_phenomena_count
environment_weather_phenomena_first airspace_altitude_agl_min_m airspace_altitude_agl_max_m
airspace_no_fly_zones_count airspace_no_fly_zones_sample_radius_m airspace_no_fly_zones_sample_floor_m
airspace_no_fly_zones_sample_ceiling_m spawn_xyz_first spawn_yaw_deg landing_preferred_sites_count
landing_preferred_sites_x_mean landing_preferred_sites_x_std landing_preferred_sites_x_min
landing_preferred_sites_x_max landing_preferred_sites_x_range landing_preferred_sites_y_mean
landing_preferred_sites_y_std landing_preferred_sites_y_min landing_preferred_sites_y_max
landing_preferred_sites_y_range landing_preferred_sites_z_mean landing_preferred_sites_z_std
landing_preferred_sites_z_min landing_preferred_sites_z_max landing_preferred_sites_z_range
landing_emergency_sites_count landing_emergency_sites_x_mean landing_emergency_sites_x_std
landing_emergency_sites_x_min landing_emergency_sites_x_max landing_emergency_sites_x_range
landing_emergency_sites_y_mean landing_emergency_sites_y_std landing_emergency_sites_y_min
landing_emergency_sites_y_max landing_emergency_sites_y_range landing_emergency_sites_z_mean
landing_emergency_sites_z_std landing_emergency_sites_z_min landing_emergency_sites_z_max
landing_emergency_sites_z_range mission_type mission_waypoints_count mission_waypoints_x_mean mission_waypoints_x_std
mission_waypoints_x_min mission_waypoints_x_max mission_waypoints_x_range mission_waypoints_y_mean
mission_waypoints_y_std mission_waypoints_y_min mission_waypoints_y_max mission_waypoints_y_range
mission_waypoints_z_mean mission_waypoints_z_std mission_waypoints_z_min mission_waypoints_z_max
mission_waypoints_z_range mission_pattern mission_time_budget_s mission_runway_required traffic_count
traffic_sample_speed_mps traffic_sample_heading_deg moving_obstacles_count moving_obstacles_sample_radius_m
swarm_enabled controls_mode controls_actions_count controls_actions_first daa_sep_threshold_m daa_ttc_threshold_s
faults_count faults_sample_t_s faults_sample_type faults_sample_duration_s faults_sample_severity comms_uplink_ok
comms_downlink_ok comms_loss_windows_count comms_loss_windows_x_mean comms_loss_windows_x_std comms_loss_windows_x_min
comms_loss_windows_x_max comms_loss_windows_x_range comms_loss_windows_y_mean comms_loss_windows_y_std
comms_loss_windows_y_min comms_loss_windows_y_max comms_loss_windows_y_range comms_rssi_dbm_min
airspace_no_fly_zones_dynamic_count airspace_no_fly_zones_dynamic_sample_radius_m
airspace_no_fly_zones_dynamic_sample_floor_m airspace_no_fly_zones_dynamic_sample_ceiling_m autofix_uav_physics_count
autofix_uav_physics_first uav_aero_wing_area_m2 uav_aero_aspect_ratio uav_aero_cl_max uav_aero_cd0
uav_aero_prop_efficiency uav_aero_stall_speed_mps airspace_runway_threshold_count airspace_runway_threshold_first
airspace_runway_heading_deg airspace_runway_length_m environment_wind_profile_count
environment_wind_profile_sample_alt_m environment_wind_profile_sample_wind_mps environment_wind_profile_sample_dir_deg
environment_thermal_plumes_count environment_thermal_plumes_sample_radius_m environment_thermal_plumes_sample_w_up_mps
environment_gnss_multipath environment_gnss_jam_dbm environment_em_interference
mission_transition_profile_vtol_to_ff_t_s mission_transition_profile_ff_to_vtol_t_s swarm_size swarm_roles_count
swarm_roles_first swarm_inter_uav_sep_min_m uav_rotorcraft_max_climb_mps uav_rotorcraft_hover_ceiling_m
mission_loiter_radius_m airspace__geofence__sample__points_count airspace__no__fly__zones__sample__center_count
landing__preferred__sites__sample_count landing__emergency__sites__sample_count mission__waypoints__sample_count
traffic__sample__spawn_count moving__obstacles__sample__center_count moving__obstacles__sample__vel_count
comms__loss__windows__sample_count airspace__no__fly__zones__dynamic__sampl_count
environment__thermal__plumes__sample__ce_count feat_disk_loading feat_altitude_range feat_reserve_utilization
feat_wind_gust_ratio feat_wind_speed_ratio feat_sensor_redundancy feat_comms_health feat_traffic_density
feat_fault_risk feat_weather_severity uav_rotorcraft_rotor_count_was_missing autofix_uav_physics_count_was_missing
autofix_uav_physics_first_was_missing uav_aero_wing_area_m2_was_missing uav_aero_aspect_ratio_was_missing
uav_aero_cl_max_was_missing uav_aero_cd0_was_missing uav_aero_prop_efficiency_was_missing
uav_aero_stall_speed_mps_was_missing airspace_runway_threshold_count_was_missing
airspace_runway_threshold_first_was_missing airspace_runway_heading_deg_was_missing
airspace_runway_length_m_was_missing mission_transition_profile_vtol_to_ff_t_s_was_missing
mission_transition_profile_ff_to_vtol_t_s_was_missing swarm_size_was_missing swarm_roles_count_was_missing
swarm_roles_first_was_missing swarm_inter_uav_sep_min_m_was_missing uav_rotorcraft_max_climb_mps_was_missing
uav_rotorcraft_hover_ceiling_m_was_missing mission_loiter_radius_m_was_missing
""".split()
PROFILE_RAW = """
uav_mass_kg uav_battery_wh uav_fuel_l uav_energy_source uav_max_speed_mps uav_max_tilt_deg uav_reserve_fraction
uav_rotorcraft_rotor_count uav_sensors_gnss uav_sensors_lidar uav_sensors_radar uav_sensors_camera_rgb
uav_sensors_camera_thermal uav_aero_prop_efficiency uav_rotorcraft_max_climb_mps uav_rotorcraft_hover_ceiling_m
""".split()
SCENARIO_RAW = """
uav_payload_mass_kg environment_weather_wind_mps environment_weather_wind_dir_deg environment_weather_gust_mps
environment_weather_phenomena_count environment_gnss_multipath environment_gnss_jam_dbm environment_em_interference
airspace_altitude_agl_min_m airspace_altitude_agl_max_m airspace_no_fly_zones_count
airspace_no_fly_zones_sample_radius_m airspace_no_fly_zones_sample_floor_m airspace_no_fly_zones_sample_ceiling_m
airspace_no_fly_zones_dynamic_count airspace_runway_length_m spawn_xyz_first spawn_yaw_deg
landing_preferred_sites_count landing_preferred_sites_z_mean landing_emergency_sites_count mission_waypoints_count
mission_waypoints_z_mean mission_pattern mission_time_budget_s mission_runway_required mission_loiter_radius_m
traffic_count traffic_sample_speed_mps moving_obstacles_count moving_obstacles_sample_radius_m swarm_enabled
swarm_size swarm_roles_first swarm_inter_uav_sep_min_m controls_mode daa_sep_threshold_m daa_ttc_threshold_s
faults_count faults_sample_duration_s faults_sample_severity comms_uplink_ok comms_downlink_ok
comms_loss_windows_count comms_rssi_dbm_min
""".split()
CORE_FEATURES = """
uav_energy_source_fuel uav_energy_source_hybrid mission_pattern_custom mission_pattern_grid mission_pattern_orbit
mission_pattern_spiral controls_mode_discrete swarm_enabled swarm_size swarm_inter_uav_sep_min_m
swarm_roles_first_relay swarm_roles_first_scout swarm_roles_first_single swarm_roles_first_solo uav_mass_kg
uav_battery_wh uav_fuel_l uav_payload_mass_kg uav_max_speed_mps uav_max_tilt_deg uav_reserve_fraction
uav_rotorcraft_rotor_count uav_rotorcraft_max_climb_mps uav_rotorcraft_hover_ceiling_m uav_aero_prop_efficiency
uav_sensors_gnss uav_sensors_lidar uav_sensors_radar uav_sensors_camera_rgb uav_sensors_camera_thermal
environment_weather_wind_mps environment_weather_wind_dir_deg environment_weather_gust_mps
environment_weather_phenomena_count environment_gnss_jam_dbm environment_gnss_multipath environment_em_interference
airspace_altitude_agl_min_m airspace_altitude_agl_max_m airspace_no_fly_zones_count
airspace_no_fly_zones_sample_radius_m airspace_no_fly_zones_sample_floor_m airspace_no_fly_zones_sample_ceiling_m
airspace_no_fly_zones_dynamic_count mission_runway_required airspace_runway_length_m spawn_xyz_first spawn_yaw_deg
landing_preferred_sites_count landing_preferred_sites_z_mean landing_emergency_sites_count mission_waypoints_count
mission_waypoints_z_mean mission_time_budget_s mission_loiter_radius_m traffic_count traffic_sample_speed_mps
moving_obstacles_count moving_obstacles_sample_radius_m daa_sep_threshold_m daa_ttc_threshold_s comms_uplink_ok
comms_downlink_ok comms_rssi_dbm_min comms_loss_windows_count faults_count faults_sample_severity
faults_sample_duration_s
""".split()
DROPPED_RAW = """
uav_type environment_airspace environment_weather_visibility environment_weather_phenomena_first mission_type
faults_sample_type autofix_uav_physics_first
""".split()
PROFILE_IDENTITY = "user_id profile_id profile_name".split()
PROFILE_CAPABILITIES = "max_payload_kg max_takeoff_mass_kg runway_capable swarm_capable max_swarm_size".split()
SENSORS = "uav_sensors_gnss uav_sensors_lidar uav_sensors_radar uav_sensors_camera_rgb uav_sensors_camera_thermal".split()
FLAGS = "mission_runway_required swarm_enabled comms_uplink_ok comms_downlink_ok environment_gnss_multipath environment_em_interference".split()
MAY_BE_NEGATIVE = "environment_gnss_jam_dbm comms_rssi_dbm_min".split()
CATEGORIES = {
    "uav_energy_source": "battery fuel hybrid".split(),
    "mission_pattern": "corridor custom grid orbit spiral".split(),
    "controls_mode": "continuous discrete".split(),
    "controls_actions_first": "fwd hold throttle".split(),
    "swarm_roles_first": "leader relay scout single solo".split(),
}
DROPPED_DEFAULTS = {
    "uav_type": "unknown",
    "environment_airspace": "unknown",
    "environment_weather_visibility": 0.0,
    "environment_weather_phenomena_first": "none",
    "mission_type": "unknown",
    "faults_sample_type": "none",
    "autofix_uav_physics_first": 0.0,
}
#: Columns that count what others sample, and two more that users may not set.
INTERNAL_COUNTS = """
sim_policy_frequency autofix_uav_physics_count controls_actions_count airspace__geofence__sample__points_count
airspace__no__fly__zones__sample__center_count landing__preferred__sites__sample_count
landing__emergency__sites__sample_count mission__waypoints__sample_count traffic__sample__spawn_count
moving__obstacles__sample__center_count moving__obstacles__sample__vel_count comms__loss__windows__sample_count
airspace__no__fly__zones__dynamic__sampl_count environment__thermal__plumes__sample__ce_count
""".split()
#: Generated columns that are missing unless overridden; the other ``_was_missing`` flags are 0.
MISSING_UNLESS_SET = """
autofix_uav_physics_count uav_aero_wing_area_m2 uav_aero_aspect_ratio uav_aero_cl_max uav_aero_cd0
uav_aero_stall_speed_mps airspace_runway_threshold_count airspace_runway_threshold_first airspace_runway_heading_deg
mission_transition_profile_vtol_to_ff_t_s mission_transition_profile_ff_to_vtol_t_s swarm_roles_count
""".split()

MISSING = "_was_missing"
GENERATED = [x for x in RAW_FEATURES if x not in {*PROFILE_RAW, *SCENARIO_RAW, *DROPPED_RAW}]
INTERNAL_ONLY = [x for x in GENERATED if x.endswith(MISSING) or x in INTERNAL_COUNTS]
OVERRIDABLE = [x for x in GENERATED if x not in INTERNAL_ONLY]
#: One-hot names: every category of a column but its first.
ONE_HOT = [f"{c}_{v}" for c, values in CATEGORIES.items() for v in values[1:]]
PROFILE_NUMERIC = [x for x in PROFILE_RAW if x not in CATEGORIES]
SCENARIO_NUMERIC = [x for x in SCENARIO_RAW if x not in CATEGORIES]

assert len(RAW_FEATURES) == 197 and len(PROFILE_RAW) == 16 and len(SCENARIO_RAW) == 45
assert len(GENERATED) == 129 and len(DROPPED_RAW) == 7 and len(OVERRIDABLE) == 93 and len(ONE_HOT) == 13
