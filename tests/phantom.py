"""The public IBSI digital phantom and the published values of its features.

Fixed values: (feature, value, tolerance) for the whole phantom and for its
third slice, with six bins and all islands.
"""

import math

import numpy as np

_SLICES = """
1 4 4 1 1  1 4 4 1 1  1 4 4 . .  1 4 4 . .
1 4 6 1 1  1 1 6 1 1  1 1 1 1 1  1 1 1 1 1
4 1 6 4 1  . 1 3 1 1  1 1 . 1 1  1 1 1 1 1
4 4 6 4 1  4 4 6 1 1  1 1 6 1 1  1 1 6 1 1
"""


def phantom():
    """Image and mask, indexed (x, y, z)."""
    rows = [line.split() for line in _SLICES.strip().splitlines()]
    cell = lambda x, y, z: rows[y][5 * z + x]
    image, mask = np.zeros((5, 4, 4)), np.zeros((5, 4, 4), int)
    for x, y, z in np.ndindex(5, 4, 4):
        if cell(x, y, z) != ".":
            image[x, y, z], mask[x, y, z] = float(cell(x, y, z)), 1
    return image, mask


def agrees(actual, wanted, tolerance):
    """Agreement to the third significant digit, as the values are published."""
    digits = 3 - (1 + math.floor(math.log10(abs(wanted)))) if wanted else 0
    scale = 10.0**digits
    return math.floor(abs(actual - wanted) * scale) / scale <= tolerance


VALUES_3D = [
    ("firstorder_entropy", 1.27, 0),
    ("firstorder_energy", 567, 0),
    ("firstorder_median", 1, 0),
    ("firstorder_range", 5, 0),
    ("firstorder_maximum", 6, 0),
    ("firstorder_robust_mean_absolute_deviation", 1.11, 0),
    ("firstorder_percentile10", 1, 0),
    ("firstorder_percentile90", 4, 0),
    ("firstorder_minimum", 1, 0),
    ("firstorder_mean", 2.15, 0),
    ("firstorder_uniformity", 0.512, 0),
    ("firstorder_variance", 3.05, 0),
    ("firstorder_interquartile_range", 3, 0),
    ("firstorder_root_mean_squared", 2.77, 0),
    ("firstorder_mean_absolute_deviation", 1.55, 0),
    ("firstorder_skewness", 1.08, 0),
    ("firstorder_total_energy", 4536, 0),
    ("firstorder_kurtosis", 2.6453795193121667, 0),
    ("firstorder_standard_deviation", 1.7570401047374198, 0),
    ("glcm_Autocorrelation", 5.06, 0),
    ("glcm_ClusterProminence", 145, 0),
    ("glcm_ClusterShade", 16.6, 0),
    ("glcm_ClusterTendency", 7.07, 0),
    ("glcm_Contrast", 5.32, 0),
    ("glcm_Correlation", 0.157, 0),
    ("glcm_DifferenceAverage", 1.43, 0),
    ("glcm_DifferenceEntropy", 1.56, 0),
    ("glcm_DifferenceVariance", 3.06, 0),
    ("glcm_Id", 0.677, 0),
    ("glcm_Idm", 0.618, 0),
    ("glcm_Idmn", 0.898, 0),
    ("glcm_Idn", 0.851, 0),
    ("glcm_Imc1", -0.157, 0),
    ("glcm_Imc2", 0.52, 0),
    ("glcm_InverseVariance", 0.0604, 0),
    ("glcm_JointAverage", 2.14, 0),
    ("glcm_JointEntropy", 2.4, 0),
    ("glcm_MaximumProbability", 0.503, 0),
    ("glcm_SumAverage", 4.29, 0),
    ("glcm_SumEntropy", 1.92, 0),
    ("glcm_Mcc", 0.44, 0),
    ("glcm_SumSquares", 3.09, 0),
    ("glcm_JointEnergy", 0.3029, 0),
    ("gldm_DependenceEntropy", 4.4, 0),
    ("gldm_DependenceNonUniformity", 4.86, 0),
    ("gldm_DependenceNonUniformityNormalized", 0.0657, 0),
    ("gldm_DependenceVariance", 22.1, 0),
    ("gldm_GrayLevelNonUniformity", 37.9, 0),
    ("gldm_GrayLevelVariance", 3.05, 0),
    ("gldm_HighGrayLevelEmphasis", 7.66, 0),
    ("gldm_LargeDependenceEmphasis", 109, 0),
    ("gldm_LargeDependenceHighGrayLevelEmphasis", 235, 0),
    ("gldm_LargeDependenceLowGrayLevelEmphasis", 102, 0),
    ("gldm_LowGrayLevelEmphasis", 0.693, 0),
    ("gldm_SmallDependenceEmphasis", 0.045, 0),
    ("gldm_SmallDependenceHighGrayLevelEmphasis", 0.736, 0),
    ("gldm_SmallDependenceLowGrayLevelEmphasis", 0.00963, 0),
    ("glrlm_GrayLevelNonUniformity", 21.8, 0),
    ("glrlm_GrayLevelNonUniformityNormalized", 0.43, 0),
    ("glrlm_GrayLevelVariance", 3.46, 0),
    ("glrlm_HighGrayLevelRunEmphasis", 9.7, 0),
    ("glrlm_LongRunEmphasis", 3.06, 0),
    ("glrlm_LongRunHighGrayLevelEmphasis", 17.6, 0),
    ("glrlm_LongRunLowGrayLevelEmphasis", 2.39, 0),
    ("glrlm_LowGrayLevelRunEmphasis", 0.603, 0),
    ("glrlm_RunEntropy", 2.43, 0),
    ("glrlm_RunLengthNonUniformity", 26.9, 0),
    ("glrlm_RunLengthNonUniformityNormalized", 0.513, 0),
    ("glrlm_RunPercentage", 0.68, 0),
    ("glrlm_RunVariance", 0.574, 0),
    ("glrlm_ShortRunEmphasis", 0.705, 0),
    ("glrlm_ShortRunHighGrayLevelEmphasis", 8.540, 0),
    ("glrlm_ShortRunLowGrayLevelEmphasis", 0.352, 0),
    ("glszm_GrayLevelNonUniformity", 1.4, 0),
    ("glszm_GrayLevelNonUniformityNormalized", 0.28, 0),
    ("glszm_GrayLevelVariance", 2.64, 0),
    ("glszm_HighGrayLevelZoneEmphasis", 15.6, 0),
    ("glszm_LargeAreaEmphasis", 550, 0),
    ("glszm_LargeAreaHighGrayLevelEmphasis", 1490, 0),
    ("glszm_LargeAreaLowGrayLevelEmphasis", 503, 0),
    ("glszm_LowGrayLevelZoneEmphasis", 0.253, 0),
    ("glszm_SizeZoneNonUniformity", 1, 0),
    ("glszm_SizeZoneNonUniformityNormalized", 0.2, 0),
    ("glszm_SmallAreaEmphasis", 0.255, 0),
    ("glszm_SmallAreaHighGrayLevelEmphasis", 2.76, 0),
    ("glszm_SmallAreaLowGrayLevelEmphasis", 0.0256, 0),
    ("glszm_ZoneEntropy", 2.32, 0),
    ("glszm_ZonePercentage", 0.0676, 0),
    ("glszm_ZoneVariance", 331, 0),
    ("ngtdm_Busyness", 6.54, 0),
    ("ngtdm_Coarseness", 0.0296, 0),
    ("ngtdm_Complexity", 13.5, 0),
    ("ngtdm_Contrast", 0.584, 0),
    ("ngtdm_Strength", 0.763, 0),
    ("shape3d_surface_area", 388, 3),
    ("shape3d_mesh_volume", 556, 4),
    ("shape3d_surface_volume_ratio", 0.698, 0.004),
    ("shape3d_sphericity", 0.843, 0.005),
    ("shape3d_major_axis_length", 11.4, 0.1),
    ("shape3d_maximum_3d_diameter", 13.1, 0.1),
    ("shape3d_minor_axis_length", 9.31, 0.06),
    ("shape3d_least_axis_length", 8.54, 0.05),
    ("shape3d_elongation", 0.816, 0.005),
    ("shape3d_flatness", 0.749, 0.005),
    ("shape3d_voxel_volume", 592, 4),
    ("shape3d_number_of_islands", 1, 0),
]

VALUES_2D = [
    ("firstorder_entropy", 0.8343470230852528, 0),
    ("firstorder_energy", 82.0, 0),
    ("firstorder_median", 1.0, 0),
    ("firstorder_range", 5.0, 0),
    ("firstorder_maximum", 6, 0),
    ("firstorder_robust_mean_absolute_deviation", 0.65625, 0),
    ("firstorder_percentile10", 1.0, 0),
    ("firstorder_percentile90", 4.0, 0),
    ("firstorder_minimum", 1.0, 0),
    ("firstorder_mean", 1.6470588235294117, 0),
    ("firstorder_uniformity", 0.6955017301038062, 0),
    ("firstorder_variance", 2.110726643598616, 0),
    ("firstorder_interquartile_range", 0.0, 0),
    ("firstorder_root_mean_squared", 2.1962534944228786, 0),
    ("firstorder_mean_absolute_deviation", 1.065743944636678, 0),
    ("firstorder_skewness", 2.0091745503701466, 0),
    ("firstorder_total_energy", 656.0, 0),
    ("firstorder_kurtosis", 5.5822359580757865, 0),
    ("firstorder_standard_deviation", 1.4975470138942315, 0),
    ("glcm_Autocorrelation", 2.369002525252525, 0),
    ("glcm_ClusterProminence", 29.379996965839368, 0),
    ("glcm_ClusterShade", 6.349522162635246, 0),
    ("glcm_ClusterTendency", 3.379222703678196, 0),
    ("glcm_Contrast", 4.176452020202021, 0),
    ("glcm_Correlation", -0.11273883997997489, 0),
    ("glcm_DifferenceAverage", 1.0565025252525253, 0),
    ("glcm_DifferenceEntropy", 1.0620199761782945, 0),
    ("glcm_DifferenceVariance", 2.9625560370115296, 0),
    ("glcm_Id", 0.7778303872053872, 0),
    ("glcm_Idm", 0.7372693278943279, 0),
    ("glcm_Idmn", 0.9218630981950654, 0),
    ("glcm_Idn", 0.8927819865319866, 0),
    ("glcm_Imc1", -0.09725061597992121, 0),
    ("glcm_Imc2", 0.349416066931148, 0),
    ("glcm_InverseVariance", 0.02451038159371493, 0),
    ("glcm_JointAverage", 1.5907512626262625, 0),
    ("glcm_JointEntropy", 1.441418792736606, 0),
    ("glcm_MaximumProbability", 0.6941287878787878, 0),
    ("glcm_SumAverage", 3.181502525252525, 0),
    ("glcm_SumEntropy", 1.156380913948728, 0),
    ("glcm_Mcc", 0.2881064367074744, 0),
    ("glcm_SumSquares", 1.8889186809700542, 0),
    ("glcm_JointEnergy", 0.5149241387996123, 0),
    ("gldm_DependenceEntropy", 2.60985016602894, 0),
    ("gldm_DependenceNonUniformity", 3.1176470588235294, 0),
    ("gldm_DependenceNonUniformityNormalized", 0.18339100346020762, 0),
    ("gldm_DependenceVariance", 2.8304498269896197, 0),
    ("gldm_GrayLevelNonUniformity", 11.823529411764707, 0),
    ("gldm_GrayLevelVariance", 2.110726643598616, 0),
    ("gldm_HighGrayLevelEmphasis", 4.823529411764706, 0),
    ("gldm_LargeDependenceEmphasis", 22.294117647058822, 0),
    ("gldm_LargeDependenceHighGrayLevelEmphasis", 31.41176470588235, 0),
    ("gldm_LargeDependenceLowGrayLevelEmphasis", 21.795751633986928, 0),
    ("gldm_LowGrayLevelEmphasis", 0.8325163398692811, 0),
    ("gldm_SmallDependenceEmphasis", 0.127515339469121, 0),
    ("gldm_SmallDependenceHighGrayLevelEmphasis", 2.627515339469121, 0),
    ("gldm_SmallDependenceLowGrayLevelEmphasis", 0.04275226757369615, 0),
    ("glrlm_GrayLevelNonUniformity", 5.484848484848485, 0),
    ("glrlm_GrayLevelNonUniformityNormalized", 0.55749253902663, 0),
    ("glrlm_GrayLevelVariance", 3.096630366161616, 0),
    ("glrlm_HighGrayLevelRunEmphasis", 7.4251893939393945, 0),
    ("glrlm_LongRunEmphasis", 4.246212121212121, 0),
    ("glrlm_LongRunHighGrayLevelEmphasis", 12.077651515151516, 0),
    ("glrlm_LongRunLowGrayLevelEmphasis", 3.885640256734007, 0),
    ("glrlm_LowGrayLevelRunEmphasis", 0.7273187605218856, 0),
    ("glrlm_RunEntropy", 2.0820756102292672, 0),
    ("glrlm_RunLengthNonUniformity", 4.496212121212121, 0),
    ("glrlm_RunLengthNonUniformityNormalized", 0.4567263544536272, 0),
    ("glrlm_RunPercentage", 0.573529411764706, 0),
    ("glrlm_RunVariance", 0.8895560720844812, 0),
    ("glrlm_ShortRunEmphasis", 0.5864049347643098, 0),
    ("glrlm_ShortRunHighGrayLevelEmphasis", 6.660031828703703, 0),
    ("glrlm_ShortRunLowGrayLevelEmphasis", 0.33569635153619526, 0),
    ("glszm_GrayLevelNonUniformity", 1.0, 0),
    ("glszm_GrayLevelNonUniformityNormalized", 0.3333333333333333, 0),
    ("glszm_GrayLevelVariance", 4.222222222222222, 0),
    ("glszm_HighGrayLevelZoneEmphasis", 17.666666666666668, 0),
    ("glszm_LargeAreaEmphasis", 67.0, 0),
    ("glszm_LargeAreaHighGrayLevelEmphasis", 98.66666666666667, 0),
    ("glszm_LargeAreaLowGrayLevelEmphasis", 65.42592592592592, 0),
    ("glszm_LowGrayLevelZoneEmphasis", 0.3634259259259259, 0),
    ("glszm_SizeZoneNonUniformity", 1.0, 0),
    ("glszm_SizeZoneNonUniformityNormalized", 0.3333333333333333, 0),
    ("glszm_SmallAreaEmphasis", 0.4183673469387755, 0),
    ("glszm_SmallAreaHighGrayLevelEmphasis", 13.335034013605442, 0),
    ("glszm_SmallAreaLowGrayLevelEmphasis", 0.016168272864701436, 0),
    ("glszm_ZoneEntropy", 1.5849625007211552, 0),
    ("glszm_ZonePercentage", 0.17647058823529413, 0),
    ("glszm_ZoneVariance", 34.888888888888886, 0),
    ("ngtdm_Busyness", 3.940625, 0),
    ("ngtdm_Coarseness", 0.13481363996827916, 0),
    ("ngtdm_Complexity", 8.37328431372549, 0),
    ("ngtdm_Contrast", 0.7298857259166641, 0),
    ("ngtdm_Strength", 3.5422771781859765, 0),
    ("shape2d_elongation", 0.7143974655883708, 0.005),
    ("shape2d_major_axis_length", 11.63955229821705, 0.1),
    ("shape2d_maximum_diameter", 11.661903789690601, 0.1),
    ("shape2d_mesh_surface", 68.0, 4),
    ("shape2d_minor_axis_length", 8.315266662429558, 0.06),
    ("shape2d_perimeter", 38.14213562373095, 0),
    ("shape2d_perimeter_surface_ratio", 0.560913759172514, 0.004),
    ("shape2d_pixel_surface", 68.0, 0),
    ("shape2d_sphericity", 0.7663980345420807, 0.005),
    ("shape2d_number_of_islands", 1, 0),
]
