"""Controlled-vocabulary terms.

Fixed values: accessions of the public PSI-MS vocabulary, in the order in which the
enum-ordered lookups try them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BINARY_DATA_TYPE = {
    "float_32": "MS:1000521", "float_64": "MS:1000523", "int_32": "MS:1000519", "int_64": "MS:1000522", "ascii_string": "MS:1001479",
}

COMPRESSION = {
    "byte_shuffled_zstd": "MS:1003781",
    "ms_numpress_short_logged_float": "MS:1002314",
    "truncation_linear_prediction_zlib": "MS:1003090",
    "zlib_compression": "MS:1000574",
    "no_compression": "MS:1000576",
    "dictionary_encoded_zstd": "MS:1003782",
    "ms_numpress_linear_prediction_zlib": "MS:1002746",
    "truncation_zlib": "MS:1003088",
    "ms_numpress_short_logged_float_zlib": "MS:1002748",
    "ms_numpress_linear_prediction_zstd": "MS:1003783",
    "ms_numpress_positive_integer_zlib": "MS:1002747",
    "ms_numpress_short_logged_float_zstd": "MS:1003785",
    "ms_numpress_linear_prediction": "MS:1002312",
    "ms_numpress_positive_integer": "MS:1002313",
    "truncation_delta_prediction_zlib": "MS:1003089",
    "zstd_compression": "MS:1003780",
    "ms_numpress_positive_integer_zstd": "MS:1003784",
}

SPECTRUM_TYPE = {"centroid": "MS:1000127", "profile": "MS:1000128"}

SPECTRUM_COMBINATION = {"no_combination": "MS:1000795", "median": "MS:1000573", "sum": "MS:1000571", "mean": "MS:1000575"}

#: As the vocabulary defines them.  ``COMPAT_POLARITY`` has the swapped reading, for callers that need it.
POLARITY = {"positive": "MS:1000130", "negative": "MS:1000129"}
COMPAT_POLARITY = {"positive": "MS:1000129", "negative": "MS:1000130"}

SPECTRUM_TERMS = {
    "ms_level": "MS:1000511", "peak_intensity": "MS:1000042", "scan_start_time": "MS:1000016", "selected_ion_mz": "MS:1000744", "charge_state": "MS:1000041",
    "total_ion_current": "MS:1000285", "ion_injection_time": "MS:1000927", "scan_window_lower_limit": "MS:1000501", "scan_window_upper_limit": "MS:1000500",
}

BINARY_DATA_ARRAY = {
    "raw_ion_mobility": "MS:1003007", "mean_ion_mobility_drift_time": "MS:1002477", "deconvoluted_ion_mobility_drift_time": "MS:1003156",
    "mean_inverse_reduced_ion_mobility": "MS:1003006", "mean_ion_mobility": "MS:1002816", "deconvoluted_inverse_reduced_ion_mobility": "MS:1003155",
    "raw_ion_mobility_drift_time": "MS:1003153", "vacuum_pump_pressure": "MS:4000210", "raw_inverse_reduced_ion_mobility": "MS:1003008",
    "deconvoluted_ion_mobility": "MS:1003154", "time": "MS:1000595", "mean_charge": "MS:1002478", "mz": "MS:1000514",
    "sampled_noise_intensity": "MS:1002744", "flow_rate": "MS:1000820", "charge": "MS:1000516", "sampled_noise_baseline": "MS:1002745",
    "ion_mobility": "MS:1002893", "baseline": "MS:1002530", "resolution": "MS:1002529", "pressure": "MS:1000821", "intensity": "MS:1000515",
    "measured_element": "MS:1002716", "scanning_quadrupole_position_upper_bound_mz": "MS:1003158", "non_standard_data": "MS:1000786",
    "scanning_quadrupole_position_lower_bound_mz": "MS:1003157", "noise": "MS:1002742", "wavelength": "MS:1000617", "signal_to_noise": "MS:1000517",
    "mass": "MS:1003143", "temperature": "MS:1000822", "sampled_noise_mz": "MS:1002743",
}

CHROMATOGRAM_TYPE = {
    "emission": "MS:1000813", "sim": "MS:1001472", "basepeak": "MS:1000628", "pic": "MS:4000025",
    "tic": "MS:1000235", "absorption": "MS:1000812", "srm": "MS:1001473", "sic": "MS:1000627",
}

CHECKSUM_TYPE = {"md5": "MS:1000568", "sha1": "MS:1000569", "sha256": "MS:1003151"}

CONTACT = {
    "email": "MS:1000589", "url": "MS:1000588", "name": "MS:1000586", "fax_number": "MS:1001756", "address": "MS:1000587",
    "toll_free_phone_number": "MS:1001757", "phone_number": "MS:1001755", "role": "MS:1002033", "organization": "MS:1000590",
}

DISSOCIATION = {
    "supplemental_beam_type_collision_induced_dissociation": "MS:1002678",
    "higher_energy_beam_type_collision_induced_dissociation": "MS:1002481",
    "beam_type_collision_induced_dissociation": "MS:1000422",
    "ultraviolet_photodissociation": "MS:1003246",
    "trap_type_collision_induced_dissociation": "MS:1002472",
    "infrared_multiphoton_dissociation": "MS:1000262",
    "electron_activated_dissociation": "MS:1003294",
    "supplemental_collision_induced_dissociation": "MS:1002679",
    "in_source_collision_induced_dissociation": "MS:1001880",
    "low_energy_collision_induced_dissociation": "MS:1000433",
    "pulsed_q_dissociation": "MS:1000599",
    "collision_induced_dissociation": "MS:1000133",
    "sustained_off_resonance_irradiation": "MS:1000282",
    "blackbody_infrared_radiative_dissociation": "MS:1000242",
    "photodissociation": "MS:1000435",
    "surface_induced_dissociation": "MS:1000136",
    "post_source_decay": "MS:1000135",
    "electron_capture_dissociation": "MS:1000250",
    "plasma_desorption": "MS:1000134",
    "lift": "MS:1002000",
    "electron_transfer_dissociation": "MS:1000598",
    "negative_electron_transfer_dissociation": "MS:1003247",
}

ISOLATION = {"target_mz": "MS:1000827", "lower_offset": "MS:1000828", "upper_offset": "MS:1000829"}
SELECTED_ION = {
    "selected_ion_mz": "MS:1000744", "peak_intensity": "MS:1000042", "charge_state": "MS:1000041", "ir_im": "MS:1002815",
    "im_drift_time": "MS:1002476", "faims_voltage_start": "MS:1003450", "faims_voltage_end": "MS:1003451", "ccs": "MS:1002954",
}
ACTIVATION = {
    "activation_energy": "MS:1000509", "ce": "MS:1000045", "supplemental_ce": "MS:1002680", "collision_gas": "MS:1000419", "collision_gas_pressure": "MS:1000869",
}
TARGET_MZ = "MS:1000744"

VOCABULARIES = {
    "binary_data_type": BINARY_DATA_TYPE, "compression": COMPRESSION, "spectrum_type": SPECTRUM_TYPE, "spectrum_combination": SPECTRUM_COMBINATION,
    "polarity": POLARITY, "spectrum": SPECTRUM_TERMS, "binary_data_array": BINARY_DATA_ARRAY, "chromatogram_type": CHROMATOGRAM_TYPE,
    "checksum_type": CHECKSUM_TYPE, "contact": CONTACT, "dissociation": DISSOCIATION, "isolation_window": ISOLATION,
    "selected_ion": SELECTED_ION, "activation": ACTIVATION,
}


def cv_dim(spark: SparkSession) -> DataFrame:
    """vocabulary, position, label, accession: a dimension table to join decoded accessions with."""
    rows = [(v, i, k, a) for v, terms in VOCABULARIES.items() for i, (k, a) in enumerate(terms.items())]
    return spark.createDataFrame(rows, "vocabulary string, position int, label string, accession string")
